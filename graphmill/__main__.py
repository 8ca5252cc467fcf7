"""Jobs from the command line: python -m graphmill JOB ... ; options of a job may come from a JSON file (--config)."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphmill", description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("prepare", help="corpora to a dataset by split")
    a.add_argument("-i", "--inputs", nargs="+", required=True)
    a.add_argument("--langs", nargs="+", required=True)
    a.add_argument("-o", "--out", required=True)
    for flag in ("dedupe", "remove_wiki", "fix_text", "normalize_punct", "detokenize", "remove_bracketed", "split_across_languages"):
        a.add_argument(f"--{flag}", action="store_true")
    a = jobs.add_parser("fix-corpus", help="sentence lines of a corpus in one form")
    a.add_argument("input")
    a.add_argument("out")
    a = jobs.add_parser("evaluate", help="scores and intervals of prediction files")
    a.add_argument("--files", nargs="+", required=True)
    a.add_argument("--names", nargs="+", required=True)
    a.add_argument("-o", "--out", required=True)
    a = jobs.add_parser("significance", help="pairs of systems compared")
    a.add_argument("--files", nargs="+", required=True)
    a.add_argument("--names", nargs="+", required=True)
    a.add_argument("-n", type=int, default=1000)
    a.add_argument("-o", "--out", required=True)
    a = jobs.add_parser("statistics", help="lengths of a prepared dataset")
    a.add_argument("input")
    a.add_argument("-o", "--out", required=True)
    for job in jobs.choices.values():
        job.add_argument("--config", help="a JSON file whose values are defaults of the options")
    return p


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """Options of the command line over those of its JSON file; names the job doesn't know are errors."""
    p = parser()
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config")
    path = first.parse_known_args(argv)[0].config
    if path:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
        for job in p._subparsers._group_actions[0].choices.values():
            known = {a.dest: a for a in job._actions}
            job.set_defaults(**{k: v for k, v in values.items() if k in known})
            for k in values:
                if k in known:
                    known[k].required = False
        known = {a.dest for job in p._subparsers._group_actions[0].choices.values() for a in job._actions}
        if set(values) - known:
            p.error(f"unknown options in {path}: {', '.join(sorted(set(values) - known))}")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    from pyspark.sql import SparkSession

    from .operators import pipeline, scoring
    from .session import ensure_checkpoint_dir, ship
    from .sources import predictions, sinks

    spark = SparkSession.builder.appName(f"graphmill {args.job}").getOrCreate()
    ensure_checkpoint_dir(spark)
    ship(spark)
    if args.job == "prepare":
        flags = {k: getattr(args, k) for k in ("dedupe", "remove_wiki", "fix_text", "normalize_punct", "detokenize", "remove_bracketed", "split_across_languages")}
        before, ready = pipeline.prepare_dataset(spark, args.inputs, args.langs, **flags)
        pipeline.write_dataset(before, ready, args.out, {"langs": args.langs, **flags})
    elif args.job == "fix-corpus":
        pipeline.write_lines(pipeline.fix_corpus(spark, args.input), args.out)
    elif args.job == "statistics":
        sinks.write_document(pipeline.corpus_statistics(spark.read.parquet(args.input)), args.out)
    else:
        pairs, scores = pipeline.evaluate(predictions.read_systems(spark, args.files, args.names))
        if args.job == "evaluate":
            sinks.write_document(scores, args.out)
        else:
            sinks.write_table(scoring.significance(pairs, args.n), args.out)


if __name__ == "__main__":
    main()
