"""Results as nested documents, HTML pages, and the files of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.template import filled
from ..functions.text import book_number, is_prose, mime_type


def nested_words(words: DataFrame) -> DataFrame:
    """(page_id, words, word_count): a page's words in order, times to three places, flags only where they hold."""
    flag = lambda c: F.when(F.col(c), F.lit(True)).alias(c)
    third = lambda c: F.bround(c, 3).alias(c)
    row = F.struct("word_idx", F.struct("word", third("start"), third("end"), third("confidence"), flag("line_break_after"), flag("is_title")).alias("w"))
    out = words.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select("page_id", F.col("rows.w").alias("words"), F.size("rows").alias("word_count"))


def json_of(value: Column, nulls: bool = False) -> Column:
    """A value of any type as JSON, null as null; nulls: whether fields of structs that are null are written."""
    whole = F.to_json(F.array(value), {"ignoreNullFields": str(not nulls).lower()})
    return F.when(value.isNull(), "null").otherwise(F.regexp_extract(whole, r"(?s)^.(.*).$", 1))


#: Figures of a page's metrics and the places that they are rounded to.
ROUNDED = {"average_confidence": 3, "prosody_preserved_score": 3, "timing_precision_ms": 1, "word_accuracy": 3}


def issues_of(issues: DataFrame, checked: DataFrame) -> DataFrame:
    """(page_id, timestamp_issues) of pages with issues. issues: (page_id, word_idx, type, severity, message); checked: (page_id, word_count)."""
    by_type = issues.groupBy("page_id", "type").agg(F.count("*").cast("int").alias("n")).groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("issues_by_type"))
    count = lambda severity: F.count_if(F.col("severity") == severity).cast("int").alias(f"{severity}s")
    row = F.struct(F.col("word_idx").alias("word_index"), "type", "message", "severity", F.lit(None).cast("map<string,double>").alias("suggested_correction"))
    out = issues.groupBy("page_id").agg(F.count("*").cast("int").alias("total_issues"), count("error"), count("warning"), F.array_sort(F.collect_list(row.dropFields("suggested_correction"))).alias("issues"))
    full = F.transform("issues", lambda x: x.withField("suggested_correction", F.lit(None).cast("map<string,double>")))
    return out.join(by_type, "page_id").join(checked, "page_id").select("page_id", F.struct(F.col("word_count").alias("words_checked"), "total_issues", "errors", "warnings", "issues_by_type", full.alias("issues")).alias("timestamp_issues"))


def documents(words: DataFrame, header: DataFrame, metrics: DataFrame | None = None, low: DataFrame | None = None, issues: DataFrame | None = None) -> DataFrame:
    """(page_id, json): a page's stored result.

    header: page_id and any of its scalar fields; metrics: quality(); low: low_confidence_words(); issues: find_issues(). Null fields are written,
    but for a word's flags, which stand only where they hold, and for the issues of a page without any. Durations have three places.
    """
    out = header.join(nested_words(words), "page_id")
    if metrics is not None:
        own = [F.round(c, ROUNDED[c]).alias(c) if c in ROUNDED else F.col(c) for c in metrics.columns if c not in ("page_id", "word_count")]
        out = out.join(metrics.select("page_id", F.struct(*own).alias("metrics")), "page_id", "left")
    else:
        out = out.withColumn("metrics", F.lit(None).cast("struct<average_confidence:double>"))
    out = out.join(low, "page_id", "left") if low is not None else out.withColumn("low_confidence_words", F.lit(None).cast("array<string>"))
    out = out.withColumn("low_confidence_words", F.coalesce("low_confidence_words", F.array().cast("array<string>")))
    if "duration" in out.columns:
        out = out.withColumn("duration", F.round("duration", 3))
    fields = [c for c in header.columns if c != "page_id"] + ["word_count", "words", "metrics", "low_confidence_words"]
    whole = F.concat(*(F.concat(F.lit(f"{', ' if k else ''}{chr(34)}{c}{chr(34)}: "), json_of(F.col(c), nulls=c == "metrics")) for k, c in enumerate(fields)))
    if issues is not None:
        out = out.join(issues_of(issues, out.select("page_id", "word_count")), "page_id", "left")
        whole = F.concat(whole, F.when(F.col("timestamp_issues").isNotNull(), F.concat(F.lit(', "timestamp_issues": '), json_of(F.col("timestamp_issues"), nulls=True))).otherwise(""))
    return out.select("page_id", F.concat(F.lit("{"), whole, F.lit("}")).alias("json"))


def write_documents(docs: DataFrame, path: str) -> None:
    """One folder for each page."""
    docs.repartition("page_id").write.partitionBy("page_id").mode("overwrite").text(path)


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


# Accent and background of a book's pages.
THEMES = {4: ("#61a165", "rgb(224, 249, 188)"), 5: ("#514380", "rgb(225, 190, 245)")}

STYLE = ":root { --accent: #2a6f97; --page: #ffffff } body { background: var(--page); font-family: sans-serif } header { background: var(--accent) } .word.active { background: gold } .word.read { color: #888 } .no-sync { opacity: 0.7 }"

#: Lights up the word that is spoken, ends it and clears what is played again, by the rules of playback.player_changes().
SCRIPT = """(function () {
  const audio = document.querySelector('audio'), spans = [...document.querySelectorAll('.word[data-start]')].filter(s => +s.dataset.start > 0 || +s.dataset.end > 0).sort((a, b) => a.dataset.start - b.dataset.start);
  let current = -1, previous = -1;
  const set = (k, state) => { if (spans[k]) spans[k].className = 'word ' + state; };
  const clear = () => { spans.forEach((_, k) => set(k, '')); current = previous = -1; };
  function show() {
    const now = spans.findIndex(s => +s.dataset.start <= audio.currentTime && audio.currentTime < +s.dataset.end);
    if (now !== current) {
      const known = Math.max(current, previous);
      if (now >= 0 && known >= 0) for (let k = known + 1; k < now; k++) set(k, 'read');
      if (now >= 0 && current >= 0) for (let k = now + 1; k <= current; k++) set(k, '');
      if (current >= 0 && (now < 0 || now > current)) set(current, 'read');
      if (now >= 0) set(now, 'active');
      previous = current; current = now;
    }
    if (!audio.paused) requestAnimationFrame(show);
  }
  audio.addEventListener('play', () => { if (audio.currentTime < 0.1) clear(); show(); });
  audio.addEventListener('seeked', show);
  audio.addEventListener('ended', () => set(current, 'read'));
})();
"""

_WORDS = """{% for w in filter(words, x -> coalesce(x.is_title, false)) %}{% if w.start = 0 AND w.end = 0 %}<span class="word no-sync">{{ w.word }} </span>{% else %}<span class="word" data-start="{{ w.start | number }}" data-end="{{ w.end | number }}">{{ w.word }} </span>{% endif %}{% endfor %}</h2>
<div id="transcript">{% for w in filter(words, x -> NOT coalesce(x.is_title, false)) %}<span class="word" data-start="{{ w.start | number }}" data-end="{{ w.end | number }}">{{ w.word }} </span>{% if w.line_break_after %}{% if prose %}<br><br>{% else %}<br>{% endif %}{% endif %}{% endfor %}</div>"""

#: Templates by name, over page_context().
TEMPLATES = {
    "plain": "<title>{{ title }}</title>\n<h2>" + _WORDS + '\n<audio src="{{ audio_src }}"></audio> {{ duration | clock }}\n',
    "page": """<!DOCTYPE html>
<html lang="{{ language }}">
<head>
<meta charset="utf-8">
<title>{{ title }}{% if project != '' %} - {{ project }}{% endif %}</title>
{% if bundled %}
<style>{{ style | raw }}</style>
{% else %}
<link rel="stylesheet" href="./styles.css">
{% endif %}
{% if accent IS NOT NULL %}
<style>:root { --accent: {{ accent | raw }}; --page: {{ background | raw }} }</style>
{% endif %}
<script>window.PAGE = { words: {{ words | json }}, duration: {{ duration | json }}, title: {{ title | json }}, audioFile: {{ audio_file | json }} };</script>
</head>
<body class="book-{{ book }}">
<header><img src="./images/logo-{{ book }}.png" alt=""></header>
<h2>""" + _WORDS + """
<audio preload="metadata" controls><source src="{{ audio_src }}" type="{{ audio_type }}"></audio>
<span id="duration">{{ duration | clock }}</span>
{% if citation IS NOT NULL %}
<p class="citation">{{ citation | raw }}</p>
{% endif %}
{% if metrics IS NOT NULL %}
<div id="metrics" hidden>{{ round(metrics.average_confidence * 100, 1) | number }} % sure, {{ round(metrics.timing_precision_ms) | number }} ms, {{ metrics.gaps_preserved }} gaps kept, {{ metrics.gaps_filled }} filled</div>
{% endif %}
{% if bundled %}
<script>{{ script | raw }}</script>
{% else %}
<script src="./player.js"></script>
{% endif %}
</body>
</html>
""",
}


def page_context(words: DataFrame, header: DataFrame, metrics: DataFrame | None = None, project: str = "", bundled: bool = True, style: str = STYLE, script: str = SCRIPT) -> DataFrame:
    """One row for each page, with what templates read.

    header: (page_id, title, full_text, audio_file, duration), and if there are any language, citation (HTML), audio_src. A page without a title is named so.
    """
    out = header.join(nested_words(words), "page_id")
    own = {"language": F.lit("pt"), "citation": F.lit(None).cast("string"), "audio_src": F.concat(F.lit("audio/"), F.col("audio_file"))}
    out = out.withColumns({c: F.coalesce(F.col(c), v) if c in header.columns else v for c, v in own.items()})
    if metrics is not None:
        out = out.join(metrics.select("page_id", F.struct(*(c for c in metrics.columns if c != "page_id")).alias("metrics")), "page_id", "left")
    else:
        out = out.withColumn("metrics", F.lit(None).cast("struct<average_confidence:double,timing_precision_ms:double,gaps_preserved:long,gaps_filled:long>"))
    book = book_number(F.col("audio_file"))
    colour = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for b, pair in THEMES.items() for x in (b, pair[k]))), book)
    return out.withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), F.lit("Leitura Guiada")), "prose": is_prose(F.coalesce("full_text", F.lit(""))), "book": book, "accent": colour(0), "background": colour(1),
        "audio_type": mime_type(F.col("audio_file")), "project": F.lit(project), "bundled": F.lit(bundled), "style": F.lit(style), "script": F.lit(script),
    })


def html_pages(context: DataFrame, template: str = "page", templates: dict[str, str] = TEMPLATES, overrides: DataFrame | None = None) -> DataFrame:
    """(page_id, html) of page_context() by a template.

    overrides: (page_id, template, ...): a page's own template, if not null, and values of the context's columns that replace its own where they aren't null.
    A name that no template has is the default.
    """
    name = F.lit(None).cast("string")
    if overrides is not None:
        other = [c for c in overrides.columns if c in context.columns and c != "page_id"]
        context = context.join(overrides.select("page_id", F.struct("template", *other).alias("_own")), "page_id", "left")
        context, name = context.withColumns({c: F.coalesce(F.col("_own")[c], F.col(c)) for c in other}), F.col("_own.template")
    html = None
    for k, text in templates.items():
        if k != template and overrides is not None:
            html = (F if html is None else html).when(name == k, filled(text))
    html = filled(templates[template]) if html is None else html.otherwise(filled(templates[template]))
    return context.select("page_id", html.alias("html"))


def site_files(words: DataFrame, header: DataFrame, metrics: DataFrame | None = None, low: DataFrame | None = None, issues: DataFrame | None = None, audio: DataFrame | None = None, bundled: bool = True, overrides: DataFrame | None = None, project: str = "") -> DataFrame:
    """(page_id, name, content): a page's index.html, index.json, and where they are given audio.mp3 and, if not bundled, style and script.

    audio: (page_id, content). Pages with audio refer to their own file.
    """
    if audio is not None:
        audio = audio.select("page_id", "content")
        header = header.drop("audio_src").join(audio.select("page_id", F.lit("./audio.mp3").alias("audio_src")), "page_id", "left")
    text = lambda c: F.col(c).cast("binary").alias("content")
    out = html_pages(page_context(words, header, metrics, project, bundled), overrides=overrides).select("page_id", F.lit("index.html").alias("name"), text("html"))
    kept = [c for c in ("audio_file", "language", "duration", "title", "full_text") if c in header.columns]
    out = out.unionByName(documents(words, header.select("page_id", *kept), metrics, low, issues).select("page_id", F.lit("index.json").alias("name"), text("json")))
    if audio is not None:
        out = out.unionByName(audio.select("page_id", F.lit("audio.mp3").alias("name"), "content"))
    if not bundled:
        for name, content in (("styles.css", STYLE), ("player.js", SCRIPT)):
            out = out.unionByName(header.select("page_id", F.lit(name).alias("name"), F.lit(content).cast("binary").alias("content")))
    return out
