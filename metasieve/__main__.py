"""The command line: run, interactive, cost, validate and plot over a project folder.

    spark-submit ... or python -m metasieve run --project s3a://reviews/sleep --phases 1-4
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from metasieve.operators.cost import cost_table
from metasieve.operators.screening import pico_score
from metasieve.operators.writing import prisma_text
from metasieve.plans.project import PHASES, Project


def phase_range(text: str) -> tuple[int, int]:
    """`a-b` or `a`."""
    first, _, last = text.partition("-")
    try:
        return int(first), int(last or first)
    except ValueError:
        raise argparse.ArgumentTypeError(f"not a range of phases: {text}") from None


def run(project: Project, args: argparse.Namespace) -> int:
    try:
        tables = project.run(args.phases, args.resume)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"Tables of the run: {', '.join(sorted(tables))}")
    return cost(project, args)


def cost(project: Project, args: argparse.Namespace) -> int:  # noqa: ARG001
    for r in cost_table(project.costs()).orderBy("position").collect():  # a row for each agent of each phase
        print(r.line)
    return 0


def validate(project: Project, args: argparse.Namespace) -> int:  # noqa: ARG001
    found = project.validate()
    if found is None:
        print("No written sections: nothing to validate", file=sys.stderr)
        return 1
    rows = found.orderBy("section").collect()  # five sections
    for r in rows:
        print(f"{r.section:15s} {r.n_supported} supported, {r.n_contradicted} contradicted, {r.n_unsupported} unsupported")
    contradicted = sum(r.n_contradicted for r in rows)
    print(f"WARNING: {contradicted} contradicted claims, see validation" if contradicted else "All claims verified.")
    return 0


def plot(project: Project, args: argparse.Namespace) -> int:
    found = project.plot(args.type)
    if found is None:
        print(f"No run has what a {args.type} plot needs", file=sys.stderr)
        return 1
    if args.type == "prisma":
        print(project.table("prisma").select(prisma_text(F.col("counts")).alias("t")).first().t)
    print(f"Figure saved: {project.path}/figures/{args.type}")
    return 0


def interactive(project: Project, args: argparse.Namespace, ask: Callable[[str], str] = input) -> int:
    """The steps of a run, each after a yes: the question, its keywords, the studies."""
    no = lambda text: ask(f"{text} [Y/n] ").strip().lower() == "n"
    pico = project.given("pico")
    row = pico_score(pico).first()
    if row is None:
        question = ask("No pico.json. Research question, or Enter to leave: ").strip()
        if not question:
            return 1
        project.spark.createDataFrame([(question,)], "population string").coalesce(1).write.json(f"{project.path}/pico")
        row = pico_score(project.given("pico")).first()
    print(f"Completeness: {row.score} of 100")
    if no("Accept this question?"):
        return 0
    print(f"Excluding keywords: {row.exclusion_keywords or []}, required keywords: {row.required_keywords or []}")
    if no("Accept this search strategy?"):
        return 0
    n = project.given("studies").count()
    if not n:
        print("The project has no studies", file=sys.stderr)
        return 1
    if no(f"{n} studies. Go on with all phases?"):
        return 0
    args.phases, args.resume = (1, PHASES), False
    return run(project, args)


COMMANDS = {"run": run, "interactive": interactive, "cost": cost, "validate": validate, "plot": plot}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="metasieve", description="Systematic reviews on Spark")
    commands = out.add_subparsers(dest="command")
    for name in COMMANDS:
        p = commands.add_parser(name)
        p.add_argument("--project", required=True, help="project folder, which all executors reach")
        if name == "run":
            p.add_argument("--phases", type=phase_range, default=(1, PHASES), help="such as 1-6 or 5-6")
            p.add_argument("--resume", action="store_true", help="go on with the latest run")
        elif name == "plot":
            p.add_argument("--type", required=True, choices=("forest", "funnel", "prisma"))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 0
    return COMMANDS[args.command](Project(spark or SparkSession.builder.appName("metasieve").getOrCreate(), args.project), args)


if __name__ == "__main__":
    sys.exit(main())
