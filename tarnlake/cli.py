"""Command line: `python -m tarnlake.cli --sql "select ..." --data FOLDER`, or without --sql a prompt."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .session import EngineSession


def answer(session: EngineSession, sql: str, explain: bool, rows: int) -> str:
    """What is printed for a query: its plan, or plan and result."""
    if explain or not session.tables:
        return session.explain(sql, physical=bool(session.tables))
    return session.explain(sql) + "\n" + session.sql(sql)._show_string(rows, truncate=False)


def prompt(session: EngineSession, explain: bool, rows: int) -> None:
    """Read queries until `exit`, `quit` or the end of input."""
    while True:
        try:
            line = input("tarnlake> ").strip()
        except EOFError:
            return
        if line.lower() in ("exit", "quit"):
            return
        if line:
            try:
                print(answer(session, line, explain, rows))
            except (ValueError, KeyError, TypeError) as problem:
                print(f"{type(problem).__name__}: {problem}")


def main(argv: Sequence[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="tarnlake", description=__doc__)
    options.add_argument("--sql", help="a query; without it, a prompt")
    options.add_argument("--data", help="folder with <table>.parquet")
    options.add_argument("--tables", nargs="*", help="tables of the folder; all of the test data's if left out")
    options.add_argument("--explain", action="store_true", help="only explain")
    options.add_argument("--rows", type=int, default=20, help="rows printed at most")
    given = options.parse_args(argv)
    session = EngineSession(SparkSession.builder.getOrCreate())
    if given.data:
        session.register_folder(given.data, *([given.tables] if given.tables else []))
    if given.sql:
        print(answer(session, given.sql, given.explain, given.rows))
    else:
        prompt(session, given.explain, given.rows)


if __name__ == "__main__":
    main()
