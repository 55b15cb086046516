"""Sinks: deterministic JSON lines, append logs, CSV with fixed columns, partitioned packages, small reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> Column:
    """A row as JSON with members in order of their names."""
    return F.to_json(F.to_variant_object(F.struct(*df.columns)))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(sorted_json(df).alias("value")).write.mode(mode).text(path)


def append_log(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def fixed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those columns as strings in that order; missing ones and nulls are empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One file: for tables of results, which are small."""
    fixed_columns(df, columns).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def united(frames: list[DataFrame], preferred: list[str] = ()) -> DataFrame:
    """Rows of all frames; columns are the preferred ones that exist, then the others by name; missing values are null."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    first = [c for c in preferred if c in out.columns]
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def write_packages(df: DataFrame, path: str) -> None:
    """A directory for each tool and condition."""
    df.write.mode("overwrite").partitionBy("tool_name", "baseline_name").json(path)


def report_rows(df: DataFrame, most: int) -> list:
    """All rows of a result; more than ``most`` are an error, as reports are for small tables."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A result as a table."""
    rows = [[("" if v is None else str(v)).replace("|", r"\|") for v in r] for r in report_rows(df, most)]
    return "\n".join("| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def pdf(df: DataFrame, most: int = 10_000, lines: int = 60) -> bytes:
    """A result as plain pages of text, in a document of the fewest objects a reader needs."""
    text = [" | ".join(df.columns), *[" | ".join("" if v is None else str(v) for v in r) for r in report_rows(df, most)]]
    pages = [text[i : i + lines] for i in range(0, len(text), lines)]
    safe = lambda x: x.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for i, page in enumerate(pages):
        body = "BT /F1 8 Tf 30 800 Td 10 TL " + " ".join(f"({safe(x)}) Tj T*" for x in page) + " ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>", f"<< /Length {len(body.encode('latin-1'))} >>\nstream\n{body}\nendstream"]
    out, at = b"%PDF-1.4\n", []
    for n, x in enumerate(objects, 1):
        at.append(len(out))
        out += f"{n} 0 obj\n{x}\nendobj\n".encode("latin-1")
    table = "".join(f"{a:010} 00000 n \n" for a in at)
    return out + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(at) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("latin-1")


def write_summaries(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """A CSV folder for each summary (name -> rows and their columns)."""
    for name, (df, columns) in tables.items():
        write_csv(df, f"{path}/{name}", columns)


def dataset_card(df: DataFrame, name: str, keys: list[str]) -> str:
    """A text on a set of records: their number and, of each key, its values by number."""
    out = [f"# {name}", "", f"{df.count()} records.", ""]
    for k in keys:
        out += [f"## {k}", "", markdown(df.groupBy(k).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), k))]
    return "\n".join(out)


#: Characters LaTeX reads as commands.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(df: DataFrame, most: int = 10_000) -> str:
    safe = lambda v: "".join(LATEX.get(c, c) for c in ("" if v is None else str(v)))
    rows = [df.columns, *report_rows(df, most)]
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n" + "".join(" & ".join(map(safe, r)) + r" \\" + "\n" for r in rows) + "\\end{tabular}\n"
