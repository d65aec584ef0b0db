"""Command line: python -m spindrift COMMAND."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import jobs, models
from .sources import index, tables


# The names of commands and options are those that users of the command line know.
def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    p.add_argument("--store", default="store")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("harvest")
    c.add_argument("kind", nargs="?", default="alle", choices=["drucksache", "plenarprotokoll", "alle"])
    c.add_argument("--url", required=True)
    c.add_argument("--raw", default="raw")
    c.add_argument("--since")
    c.add_argument("--wahlperiode", type=int, default=21)
    c.add_argument("--zuordnung")
    c.add_argument("--follow", metavar="CHECKPOINT", help="harvest what was updated since the last run of this checkpoint")
    c = sub.add_parser("build")
    c.add_argument("kind", nargs="?", default="alle", choices=["drucksache", "plenarprotokoll", "alle"])
    c.add_argument("--raw", default="raw")
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("embed")
    c.add_argument("--limit", type=int)
    c = sub.add_parser("search")
    c.add_argument("question")
    c.add_argument("--limit", type=int, default=8)
    c.add_argument("--art")
    c.add_argument("--no-vector", action="store_true")
    c = sub.add_parser("ask")
    c.add_argument("question")
    c.add_argument("--limit", type=int)
    for name in ("publish", "resync"):
        c = sub.add_parser(name)
        c.add_argument("target")
    c = sub.add_parser("feedback")
    c.add_argument("file")
    c = sub.add_parser("index")
    c.add_argument("--neu", action="store_true")
    c.add_argument("--buckets", type=int, default=index.BUCKETS)
    c = sub.add_parser("eval")
    c.add_argument("questions")
    c.add_argument("--top-k", type=int, default=20)
    c.add_argument("--vektor-gewicht", type=float, default=1.5)
    c.add_argument("--neu", action="store_true")
    sub.add_parser("stats")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("spindrift").getOrCreate()
    # Offline stand-ins; a caller with a model service passes its own to the functions of ``jobs``.
    embedder, generator = models.HashEmbedder(), models.EchoGenerator()
    if a.command == "harvest" and a.follow:
        print(jobs.follow(spark, a.url, a.raw, a.follow, a.kind, a.wahlperiode, assignment=a.zuordnung))
    elif a.command == "harvest":
        print(jobs.harvest(spark, a.url, a.raw, a.kind, a.wahlperiode, a.since, assignment=a.zuordnung))
    elif a.command == "build":
        jobs.build(spark, a.raw, a.store, a.force, a.kind)
    elif a.command == "embed":
        jobs.embed(spark, a.store, embedder, a.limit)
    elif a.command == "search":
        rows = jobs.search(spark, a.store, a.question, None if a.no_vector else embedder, a.limit, dokumentart=a.art)
        for r in rows.collect():
            print(r["rank"], round(r["score"], 5), ",".join(r["found_by"]), r["dokumentnummer"], r["text"][:200].replace("\n", " "))
    elif a.command == "ask":
        for event in jobs.ask(spark, a.store, a.question, generator, embedder, "{frage}", "{frage}\n{kontext}", limit=a.limit):
            print(json.dumps(event, ensure_ascii=False))
    elif a.command == "publish":
        jobs.publish(spark, a.store, a.target)
    elif a.command == "resync":
        jobs.resync(spark, a.store, a.target).show(1000, False)
    elif a.command == "index":
        jobs.index(spark, a.store, a.buckets, a.neu)
    elif a.command == "feedback":
        print(jobs.feedback(spark, a.store, spark.read.schema(tables.FEEDBACK).json(a.file)))
    elif a.command == "eval":
        print(jobs.evaluate(spark, a.store, a.questions, embedder, a.top_k, a.vektor_gewicht, new=a.neu))
    elif a.command == "stats":
        print(json.dumps(jobs.stats(spark, a.store)))


if __name__ == "__main__":
    main()
