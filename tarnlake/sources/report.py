"""Timings as a table in CSV and as a report in Markdown."""

from __future__ import annotations

import csv
from collections.abc import Mapping
from pathlib import Path

HEADER = ("query", "seconds")


def write_csv(times: Mapping[str, float], path: str | Path) -> None:
    with open(path, "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(HEADER)
        out.writerows(times.items())


def markdown(times: Mapping[str, float], title: str) -> str:
    rows = [f"| {name} | {seconds:.4f} |" for name, seconds in times.items()]
    return "\n".join([f"# {title}", "", "| {} | {} |".format(*HEADER), "| --- | --- |", *rows, "", f"Slowest: {max(times, key=times.get, default='none')}.", ""])


def modes_markdown(times: Mapping[str, Mapping[str, float]], title: str) -> str:
    """Queries by modes in milliseconds, and how many times as fast each mode is as the first."""
    modes = list(next(iter(times.values()), {}))
    head = ["query", *(f"{m} ms" for m in modes), *(f"{m} speedup" for m in modes[1:])]
    rows = []
    for name, by in times.items():
        gains = (f"{speedup(by[modes[0]], by[m]):.2f}x" for m in modes[1:])
        rows.append(" | ".join([name, *(f"{1000 * by[m]:.3f}" for m in modes), *gains]))
    return "\n".join([f"# {title}", "", f"| {' | '.join(head)} |", "| --- " + "| ---: " * (len(head) - 1) + "|", *(f"| {r} |" for r in rows), ""])


def speedup(base: float, other: float) -> float:
    return base / other if other > 0 else float("inf")


def write_modes(times: Mapping[str, Mapping[str, float]], folder: str | Path, title: str) -> None:
    """benchmark_modes.csv and benchmark_modes.md in a folder."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    modes = list(next(iter(times.values()), {}))
    with open(folder / "benchmark_modes.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["query", *(f"{m}_ms" for m in modes), *(f"{m}_speedup" for m in modes[1:])])
        for name, by in times.items():
            out.writerow([name, *(round(1000 * by[m], 3) for m in modes), *(round(speedup(by[modes[0]], by[m]), 3) for m in modes[1:])])
    (folder / "benchmark_modes.md").write_text(modes_markdown(times, title))


def write_report(times: Mapping[str, float], folder: str | Path, title: str) -> None:
    """benchmark_results.csv and benchmark_report.md in a folder."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    write_csv(times, folder / "benchmark_results.csv")
    (folder / "benchmark_report.md").write_text(markdown(times, title))
