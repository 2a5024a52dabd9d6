"""python -m tessera build|pages|index|worst ...: builds a site from a folder of pages, and says what is in either."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import flattened, settings
from .operators.quality import worst_words
from .plans import site
from .sources import pages, responses


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="build the pages that are new or have changed")
    build.add_argument("content", help="folder with a folder for each page: audio, text.txt, response.json, and a citation if there is one")
    build.add_argument("site", help="folder that pages are written into, and what they were built from")
    build.add_argument("--reader", choices=sorted(responses.READERS), default="plain", help="form of the recogniser's answers")
    build.add_argument("--files", action="store_true", help="write style and script beside each page instead of into it")
    build.add_argument("--no-audio", action="store_true", help="don't copy audio")
    build.add_argument("--partitions", type=int, help="tasks that write pages")
    build.add_argument("--by", choices=("content", "stamp"), default="content", help="what tells that a page has changed")
    build.add_argument("--config", help="settings as a JSON file")
    for name, what in (("pages", "pages of a folder that have audio, and their texts"), ("due", "pages that the next build would build")):
        one = sub.add_parser(name, help=what)
        one.add_argument("content")
        if name == "due":
            one.add_argument("site")
            one.add_argument("--by", choices=("content", "stamp"), default="content")
    for name, what in (("index", "title, length and quality of a site's pages"), ("worst", "each page's first words that few are sure of")):
        one = sub.add_parser(name, help=what)
        one.add_argument("site")
        if name == "worst":
            one.add_argument("--most", type=int, default=10)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "build":
        own = None
        if args.config:
            row = spark.read.option("multiLine", True).json(args.config).first()
            own = settings(flattened(row.asDict(recursive=True)))
        n = site.build(spark, args.content, args.site, args.reader, own, bundled=not args.files, with_audio=not args.no_audio, by=args.by, partitions=args.partitions)
        print(f"{n} pages built")
    elif args.command == "pages":
        pages.discover(pages.files(spark, args.content)).show(1000, truncate=False)
    elif args.command == "due":
        folder = site.Folder.of(spark, args.content)
        site.changed(folder.fingerprints(args.by), site.last_state(spark, args.site)[0]).orderBy("page_id").show(1000, truncate=False)
    elif args.command == "index":
        site.index_of(spark, args.site).orderBy("page_id").show(1000, truncate=False)
    else:
        found = pages.words_of(pages.results(spark, f"{args.site}/*/index.json"))
        worst_words(found, args.most).orderBy("page_id", "rank").select("page_id", "rank", "word_idx", "word", F.round("confidence", 3).alias("confidence")).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
