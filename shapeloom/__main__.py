"""python -m shapeloom learn|parse|example|signal|streets ... - small jobs from the command line."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import forward, networks, signals
from .operators.mining import Settings, detect
from .operators.parsing import parse
from .operators.rules import learn
from .sources import generators, readers, writers


def _first(df) -> str:
    return df.first()["graph_id"]


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="shapeloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("learn")
    p.add_argument("graph")
    p.add_argument("-o", "--out")
    p.add_argument("--report")
    p.add_argument("--text")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--max-order", type=int)
    p.add_argument("--max-levels", type=int, default=16)
    p.add_argument("--min-frequency", type=int, default=2)
    p.add_argument("--min-order", type=int, default=2)
    p.add_argument("--frequency-cut", type=float, default=0.0)
    p.add_argument("--tolerance", type=float, default=0.05)
    p.add_argument("--prefer", choices=("gain", "dense"), default="gain")
    p.add_argument("--placement", choices=("existing", "centroid"), default="existing")
    p = sub.add_parser("parse")
    p.add_argument("graph")
    p.add_argument("grammar")
    p.add_argument("-o", "--out")
    p.add_argument("--tolerance", type=float, default=0.05)
    p.add_argument("--placement", choices=("existing", "centroid"), default="centroid")
    p.add_argument("--max-steps", type=int, default=100_000)
    p.add_argument("--quiet", action="store_true")
    p = sub.add_parser("example")
    p.add_argument("name", choices=sorted(forward.EXAMPLES))
    p.add_argument("-n", "--iterations", type=int, default=4)
    p.add_argument("-o", "--out", required=True)
    p = sub.add_parser("signal")
    p.add_argument("--edf")
    p.add_argument("--channel", type=int, default=0)
    p.add_argument("--tau", type=int)
    p.add_argument("--count", type=int, default=600)
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--band", type=float, nargs=2, metavar=("LOW", "HIGH"))
    p.add_argument("-o", "--out", required=True)
    p = sub.add_parser("streets")
    p.add_argument("json")
    p.add_argument("--trim", type=float)
    p.add_argument("-o", "--out", required=True)
    a = top.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "learn":
        graphs = readers.graph_json(spark, a.graph).check()
        g = _first(graphs.vertices)
        settings = Settings(a.tolerance, a.min_frequency, a.max_order, a.frequency_cut)
        grammar = learn(graphs, settings, a.max_levels, a.min_order, a.placement, a.prefer)
        listing = writers.grammar_text(grammar, g)
        if not a.quiet:
            print(listing)
        if a.text:
            Path(a.text).write_text(listing, encoding="utf-8")
        if a.out:
            writers.save_json(writers.grammar_dict(grammar, g), a.out)
        if a.report:
            data = writers.report(graphs, detect(graphs, settings), grammar, g)
            writers.save_json(data, a.report)
            if not a.quiet:
                print(writers.report_text(data))
    elif a.command == "parse":
        graphs = readers.graph_json(spark, a.graph).check()
        parsed = parse(graphs, readers.grammar_json(spark, a.grammar), a.placement, a.tolerance, a.max_steps, shared=True)
        g = _first(graphs.vertices)
        if not a.quiet:
            print(writers.trace_text(parsed, g))
        if a.out:
            writers.save_json(writers.trace(parsed, g), a.out)
    elif a.command == "example":
        writers.save_json(writers.graph_dict(forward.generate(forward.EXAMPLES[a.name](spark), a.iterations), "generated"), a.out)
    elif a.command == "signal":
        x = readers.edf(spark, a.edf, a.channel) if a.edf else generators.synthetic_signal(spark)
        fs = x.first()["fs"] if a.edf else 160.0
        graphs, facts = signals.signal_graph(x.select("series_id", "i", "x"), fs, a.tau, a.count, a.start, tuple(a.band) if a.band else None)
        print(facts.first())
        writers.save_json(writers.graph_dict(graphs, _first(graphs.vertices)), a.out)
    else:
        graphs = readers.street_json(spark, a.json)
        graphs = networks.largest_component(networks.trim_long_edges(graphs, a.trim) if a.trim else graphs)
        writers.save_json(writers.graph_dict(graphs, _first(graphs.vertices)), a.out)


if __name__ == "__main__":
    main()
