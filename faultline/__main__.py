"""Commands over run folders: python -m faultline COMMAND --folder F. See COMMANDS."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from faultline import config
from faultline.operators import chunks, models, reports, runs
from faultline.plans import build
from faultline.plans.build import build_corpus, build_failures
from faultline.providers import Endpoint
from faultline.sources import io, pages, schemas
from faultline.sources.adapters import corpus_pages

COMMANDS = {
    "export-schemas": "print the schemas of all tables",
    "corpus": "filter, deduplicate, sample and chunk --documents",
    "stats": "counts of the corpus",
    "fetch": "ask --endpoint, a wiki's action interface, as --agent for the pages of --titles (a table of group, title)",
    "filter": "filter, deduplicate and sample --documents, or the fetched pages",
    "chunk": "chunks of the sampled pages",
    "generate": "candidates from the chunks; by --model at --endpoint, or offline",
    "validate": "validation results of the candidates; with judge and baseline signals of --model at --endpoint",
    "select-seeds": "seeds and their clean contexts from the accepted candidates",
    "inject": "verified failure cases from the seeds; with --model at --endpoint as judge of absence",
    "evaluate": "answers of --model at --endpoint, judged by itself, or of the offline readers; other models' results stay",
    "ping": "one answer of --model at --endpoint",
    "failures": "candidates to evaluated failures from the chunks",
    "report": "evaluation by model, condition and severity",
    "validation-report": "funnel, reasons and kinds of seeds",
    "export-review": "packs for annotators below --output",
    "freeze": "copy the corpus of --source into the folder",
    "stability-run": "freeze the corpus of --source into a run of each of --seeds below the folder, and run it",
    "stability-report": "counts and rates of --runs below the folder",
    "contribution": "what each validation layer rejected in --runs below the folder",
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="faultline", description="; ".join(f"{k}: {v}" for k, v in COMMANDS.items()))
    parser.add_argument("command", choices=list(COMMANDS))
    parser.add_argument("--documents", help="Parquet table of documents")
    parser.add_argument("--folder", help="folder of the run's tables, or of several runs")
    parser.add_argument("--titles", help="Parquet table of titles")
    parser.add_argument("--endpoint", help="address of a chat endpoint or a wiki's action interface")
    parser.add_argument("--model", help="model that the endpoint serves")
    parser.add_argument("--agent", default="faultline", help="how the caller names itself to a wiki")
    parser.add_argument("--settings", help="settings file (YAML or JSON)")
    parser.add_argument("--seed", type=int)
    parser.add_argument("--seeds", type=lambda s: [int(x) for x in s.split(",")], default=[42, 123, 2026])
    parser.add_argument("--source", help="run folder with a corpus")
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--runs", type=lambda s: s.split(","), default=[])
    parser.add_argument("--output", help="folder of review packs")
    a = parser.parse_args(arguments)
    if a.command == "export-schemas":
        for name, text in schemas.export().items():
            print(f"# {name}\n{text}")
        return
    if a.command in ("ping", "fetch") and not a.endpoint or a.model and not a.endpoint or a.command == "ping" and not a.model:
        parser.error("--endpoint or --model is missing")
    model = Endpoint(a.endpoint, a.model).complete if a.model else None
    if a.command == "ping":
        print(model("Say hello in one sentence."))
        return
    if not a.folder:
        parser.error("--folder is missing")
    run = config.load(a.settings) if a.settings else config.Run()
    run = run.with_seed(a.seed) if a.seed is not None else run
    spark = spark or SparkSession.builder.appName(f"faultline-{run.run_id}").getOrCreate()
    read = lambda name: spark.read.parquet(f"{a.folder}/{name}")
    if a.command == "corpus":
        out = build_corpus(corpus_pages(spark.read.parquet(a.documents)), run, a.folder)
        print(io.to_json(chunks.dataset_stats(out["pages"], out["chunks"])))
    elif a.command == "fetch":
        fetched, failed = pages.split_asked(build.kept(pages.ask(spark.read.parquet(a.titles), pages.http_transport(a.endpoint, a.agent)), a.folder, "asked_pages"))
        print(f"pages: {build.kept(fetched, a.folder, 'raw').count()}, errors: {build.kept(failed, a.folder, 'fetch_errors').count()}")
    elif a.command == "filter":
        out = build.filter_step(corpus_pages(spark.read.parquet(a.documents)) if a.documents else read("raw"), run, a.folder)
        print(", ".join(f"{name}: {table.count()}" for name, table in out.items()))
    elif a.command == "chunk":
        print(f"chunks: {build.chunk_step(read('pages'), run, a.folder).count()}")
    elif a.command == "generate":
        print(f"candidates: {build.generate_step(read('chunks'), run, a.folder, model, a.model or '').count()}")
    elif a.command == "validate":
        made, found = read("candidates"), read("chunks")
        told = build.kept(models.signals(made, found, model, model, run.validation), a.folder, "signals") if model else None
        print(f"accepted: {build.validate_step(made, found, run, a.folder, told).where('accepted').count()}")
    elif a.command == "select-seeds":
        print(f"seeds: {build.seed_step(read('results'), read('chunks'), run, a.folder)[1].count()}")
    elif a.command == "inject":
        print(f"valid cases: {build.inject_step(read('chosen'), read('chunks'), run, a.folder, model).where('verification.injection_valid').count()}")
    elif a.command == "evaluate":
        print(reports.evaluation_report(build.evaluate_step(read("seeds"), read("verified"), run, a.folder, {a.model: model} if model else None, model)))
    elif a.command == "stats":
        print(io.to_json(chunks.dataset_stats(read("pages"), read("chunks"))))
    elif a.command == "failures":
        build_failures(read("chunks"), run, a.folder)["robustness"].show(truncate=False)
    elif a.command == "report":
        print(reports.evaluation_report(read("evaluation")))
    elif a.command == "validation-report":
        print(reports.validation_report(read("candidates"), read("results"), read("seeds")))
    elif a.command == "export-review":
        io.write_csv(reports.seed_review(read("seeds")), f"{a.output}/seeds_review")
        io.write_csv(reports.failure_review(read("verified").where("verification.injection_valid"), run.seed), f"{a.output}/failures_review")
    elif a.command == "freeze":
        print("copied: " + (", ".join(runs.freeze(spark, a.source, a.folder, a.overwrite)) or "nothing"))
    elif a.command == "stability-run":
        for seed in a.seeds:
            one = run.with_seed(seed)
            runs.freeze(spark, a.source, f"{a.folder}/{one.run_id}", a.overwrite)
            build_failures(spark.read.parquet(f"{a.folder}/{one.run_id}/chunks"), one, f"{a.folder}/{one.run_id}")
            runs.publish(spark, a.folder, one.run_id)
    else:
        names = a.runs or [run.with_seed(s).run_id for s in a.seeds]
        if a.command == "stability-report":
            print(reports.stability_report(runs.run_counts(spark, a.folder, names, a.output), runs.RATES, runs.COUNTS))
        elif (results := runs.all_results(spark, a.folder, names)) is None:
            print("no run has validation results")
        else:
            print(reports.contribution_report(results, runs.contributions(results)))


if __name__ == "__main__":
    main()
