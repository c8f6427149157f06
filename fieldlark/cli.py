"""Command line: ``python -m fieldlark.cli <command>`` over a directory of raw tables.

expand, spell, dry-run, report, missing-answers, missing-links, purge, ask and eo.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mutate, traits
from .plans.extract import Extraction, extract
from .providers import AnswerProvider, keyword_answer
from .sources import files
from .sources.tables import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldlark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, store: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if store:
            c.add_argument("tables", help="directory of the raw tables")
        for a in arguments:
            c.add_argument(a)
        return c

    expand = command("expand", "templates", "out", store=False)
    for name in traits.PLACEHOLDERS:
        expand.add_argument(f"--{name}")
    command("spell", "names", "corrections", "out", store=False)
    command("dry-run", "lines")
    command("report", "out")
    command("missing-answers", "out")
    command("missing-links")
    purge = command("purge", "species")
    purge.add_argument("--out", help="directory for the new version of the tables; without it nothing is written")
    eo = command("eo", "points", "datasets", "out")
    eo.add_argument("--n_point_table_rows", type=int)
    eo.add_argument("--n_dataset_rows", type=int)
    eo.add_argument("--form", action="store_true", help="refuse what the extraction form refuses")
    ask = command("ask", store=False)
    ask.add_argument("--context", required=True)
    ask.add_argument("--query", required=True)
    return p


def run(spark: SparkSession, argv: Sequence[str], answer: AnswerProvider | None = None) -> DataFrame | None:
    """Runs a command; gives what it would print.  ``answer`` replaces the offline provider."""
    a = parser().parse_args(argv)
    store = Store(spark, a.tables) if "tables" in a else None
    if a.command == "expand":
        lists = {n: files.read_list(spark, getattr(a, n)).select(F.col("value").alias("name")) for n in traits.PLACEHOLDERS if getattr(a, n)}
        files.write_lines(traits.expanded_line(traits.expand_templates(files.read_list(spark, a.templates), lists)), a.out)
    elif a.command == "spell":
        files.write_lines(traits.fix_lines(spark.read.text(a.names), files.read_corrections(spark, a.corrections)), a.out)
    elif a.command == "dry-run":
        return traits.dry_run(traits.parse_expanded(files.read_list(spark, a.lines)), store.species, store.questions, store.species_questions)
    elif a.command == "report":
        files.write_csv(traits.report(store).orderBy("species", "question_id", "answer_id"), a.out, quote_all=True)
    elif a.command == "missing-answers":
        files.write_csv(traits.missing_answers(store), a.out)
    elif a.command == "missing-links":
        return traits.grouped_report(traits.unlinked_species_questions(store)).orderBy("species_name")
    elif a.command == "purge":
        names = files.read_list(spark, a.species).select(F.col("value").alias("name"))
        left, counts = mutate.purge(store, names)
        for table, df in left.items() if a.out else ():
            df.write.mode("overwrite").parquet(f"{a.out}/{table}.parquet")
        return counts
    elif a.command == "ask":
        one = spark.range(1).select(F.lit(a.context).alias("context"), F.lit(a.query).alias("question"))
        return one.select("question", traits.one_question(F.col("context"), F.col("question"), answer or keyword_answer).alias("answer"))
    elif a.command == "eo":
        points = files.read_points(spark, a.points, a.n_point_table_rows)
        table = files.read_dataset_table(spark, a.datasets, a.n_dataset_rows)
        wanted = [Extraction(r[0], r[1], r[2], r[3]) for r in table.collect()]  # a hand-written table
        named = points.withColumnsRenamed({"Latitude": "latitude", "Longitude": "longitude", "Year": "year"})
        locations = store.point.select(F.col("id_key").alias("pixel_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
        files.write_csv(extract(named, store.raster, locations, wanted, cli=True, form=a.form), a.out)
    return None


def main() -> None:
    spark = SparkSession.builder.appName("fieldlark").getOrCreate()
    out = run(spark, sys.argv[1:])
    if out is not None:
        out.show(1000, truncate=False)


if __name__ == "__main__":
    main()
