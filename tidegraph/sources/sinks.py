"""Writers and report formats (K1-K6)."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text without quotes; the committer renames on success, so no half-written output is seen (K1, K3)."""
    df.write.mode("overwrite").option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by(df: DataFrame, path: str, columns: Sequence[str] = ("snapshot", "delta")) -> None:
    """One folder for each value of the columns (K2): rows are not dealt out by them, so a hot delta has several files."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def check_paths(source: str, output: str) -> None:
    """Raises if the output is, holds, or lies in the source (K6)."""

    def normal(p: str) -> tuple[str, str, str]:
        u = urlparse(p)
        return u.scheme or "file", u.netloc, posixpath.normpath(u.path).rstrip("/") + "/"

    (s1, n1, a), (s2, n2, b) = normal(source), normal(output)
    if (s1, n1) == (s2, n2) and (a.startswith(b) or b.startswith(a)):
        raise ValueError(f"output {output} overlaps source {source}")


def _rows(df: DataFrame, most: int) -> list[list[str]]:
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [["" if v is None else str(v) for v in r] for r in got]


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table (K4)."""
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, _rows(df, most))])


def latex(df: DataFrame, most: int = 1000) -> str:
    """A small result as a LaTeX tabular (K4)."""
    safe = lambda c: c.replace("\\", r"\textbackslash{}").replace("&", r"\&").replace("%", r"\%").replace("_", r"\_").replace("#", r"\#")
    line = lambda cells: " & ".join(map(safe, cells)) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", line(df.columns), r"\hline", *map(line, _rows(df, most)), r"\end{tabular}"])


def ascii_table(df: DataFrame, most: int = 1000) -> str:
    """A small result in columns of equal width (K4)."""
    rows = [list(df.columns), *_rows(df, most)]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


def manifest(counters: dict[str, int], **more: object) -> str:
    """Counters of a run as JSON text."""
    return json.dumps({"counters": counters, **more}, indent=1, sort_keys=True)
