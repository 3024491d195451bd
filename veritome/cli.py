"""Command line: ``python -m veritome.cli <command>``."""

from __future__ import annotations

import argparse

from veritome import model
from veritome.operators import cost, overview, stats
from veritome.operators.audit import audit_runs
from veritome.operators.selection import STRATEGIES, strategy
from veritome.prompts import VARIANTS
from veritome.session import session
from veritome.sources import pages as page_source
from veritome.sources import sinks, synthetic
from veritome.sources.runs import RunStore


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="veritome")
    sub = out.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest", help="clean documents into the cache")
    p.add_argument("folder"), p.add_argument("cache"), p.add_argument("--pattern", default="*.txt"), p.add_argument("--force", action="store_true")
    p = sub.add_parser("select", help="show what each strategy sends")
    p.add_argument("cache"), p.add_argument("--strategy", choices=STRATEGIES, action="append")
    p = sub.add_parser("runs", help="list runs with their summaries")
    p.add_argument("store")
    p = sub.add_parser("audit", help="audit a run against its repetition and another input")
    p.add_argument("store"), p.add_argument("run"), p.add_argument("--out", required=True)
    for role in ("repetition", "other-input", "other-temperature", "other-prompt"):
        p.add_argument(f"--{role}")
    p = sub.add_parser("extract", help="one run over cached documents")
    p.add_argument("cache"), p.add_argument("store"), p.add_argument("--strategy", choices=STRATEGIES, default="hybrid"), p.add_argument("--variant", choices=VARIANTS, default="v_full")
    p.add_argument("--temperature", type=float, default=0.0), p.add_argument("--repetition", type=int, default=1), p.add_argument("--resume")
    p.add_argument("--backend", choices=model.BACKENDS, default="stub"), p.add_argument("--model"), p.add_argument("--base-url")
    p = sub.add_parser("cost", help="cost by run")
    p.add_argument("store"), p.add_argument("--input-price", type=float, default=3.0), p.add_argument("--output-price", type=float, default=15.0)
    p = sub.add_parser("rehearse", help="a whole study on invented articles with the stub model")
    p.add_argument("store"), p.add_argument("--documents", type=int, default=5), p.add_argument("--variant", choices=VARIANTS, default="v_full"), p.add_argument("--out", required=True)
    return out


def main(argv: list[str] | None = None) -> int:
    from veritome.report import Report
    from veritome.runner import rehearse, run_and_store

    a = parser().parse_args(argv)
    spark = session()
    if a.command == "ingest":
        page_source.ingest(spark, a.folder, a.cache, a.pattern, force=a.force).groupBy("doc").count().show()
    elif a.command == "select":
        pages = page_source.load_cached(spark, a.cache).select("doc", "page", "text")
        overview.recall_of(pages, {n: strategy(n) for n in a.strategy or STRATEGIES}).show(truncate=False)
    elif a.command == "runs":
        stats.run_summary(RunStore(spark, a.store).load(), "run_id").orderBy("run_id").show(truncate=False)
    elif a.command == "audit":
        store = RunStore(spark, a.store)
        roles = {"primary": a.run, "repetition": a.repetition, "other_input": a.other_input, "other_temperature": a.other_temperature, "other_prompt": a.other_prompt}
        found = audit_runs(store.load, {k: v for k, v in roles.items() if v})
        print(*sinks.write_table(found.tables()["cards"], a.out, a.run).values(), Report(a.run, model=a.run).write(f"{a.out}/{a.run}.html", found))
    elif a.command == "extract":
        options = {k: v for k, v in (("model_name", a.model), ("base_url", a.base_url)) if v}
        pages = page_source.load_cached(spark, a.cache).select("doc", "page", "text")
        params = model.Params(temperature=a.temperature)
        print(run_and_store(spark, RunStore(spark, a.store), pages, strategy(a.strategy), model.client(a.backend, **options), variant=a.variant, params=params, repetition=a.repetition, resume=a.resume))
    elif a.command == "cost":
        cost.cost(RunStore(spark, a.store).load(), cost.Price(a.input_price, a.output_price), "run_id").orderBy("run_id").show(truncate=False)
    elif a.command == "rehearse":
        table = rehearse(spark, RunStore(spark, a.store), synthetic.corpus(spark, a.documents), strategy("hybrid"), strategy("first_pages"))
        print(*sinks.write_table(table, a.out, "rehearsal").values())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
