"""The code index: what changed, sections and symbols of files, a full build and a refresh.

files: path, text, content_hash. Sections are cut with SQL functions; symbols of Python come from its own parser, those
of other languages from their tokens and scopes (operators.symbols).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import BLANK_ENDS, build_embed_text, chunk_strategy, is_excluded, language_of, lines_of
from tidemark.operators.history import LIMIT, file_history, file_links, history_commits, history_scores, link_chunks, merged_history, with_hotspots
from tidemark.operators.symbols import PREVIEW_LINES, code_symbols
from tidemark.operators.vectors import Embedder, embed_text

NAME_CHARS = 120
#: Where a section begins, by language.
BOUNDARIES = {
    "markdown": r"^#{1,6}\s",
    "toml": r"^\[",
    "yaml": r"^[^\s#-][^:]*:",
    "diff": r"^(diff |@@ )",
    "css": r"^[^\s}@/][^{]*\{|^@",
    "json": r"^ {2}\"[^\"]+\"\s*:|^\t\"[^\"]+\"\s*:",
    "html": r"^<[a-zA-Z]",
    "xml": r"^\s{0,2}<[a-zA-Z]",
    "hcl": r"^[a-zA-Z_]+[^=]*\{",
}
CHUNK_SCHEMA = "path string, symbol_name string, qualified_name string, symbol_kind string, signature string, doc_comment string, body_preview string, line_start long, line_end long"


def diff_manifest(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, change): new, changed, unchanged or deleted."""
    a, b = current.select("path", F.col("content_hash").alias("now_hash")), indexed.select("path", F.col("content_hash").alias("old_hash"))
    joined = a.withColumn("_now", F.lit(1)).join(b.withColumn("_old", F.lit(1)), "path", "full_outer")
    return joined.select("path", F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("now_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed").alias("change"))


def chunk_sections(files: DataFrame) -> DataFrame:
    """Sections of structured files, named after their first line that isn't blank; SQL files fall into statements."""
    typed = files.select("path", "text", language_of("path").alias("language"))
    lines = typed.select("path", "language", F.posexplode(lines_of("text")).alias("pos", "line"))
    begins = F.lit(False)
    for language, pattern in BOUNDARIES.items():
        begins = begins | ((F.col("language") == language) & F.col("line").rlike(pattern))
    order = W.partitionBy("path").orderBy("pos")
    after = (F.col("language") == "sql") & F.coalesce(F.lag("line").over(order).rlike(r";\s*$"), F.lit(False))
    numbered = lines.withColumn("_begins", begins | after).withColumn("_section", F.sum(F.col("_begins").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    blank = F.regexp_replace("line", BLANK_ENDS, "") == ""
    sections = numbered.groupBy("path", "_section").agg(
        F.array_sort(F.collect_list(F.when(~blank, F.struct("pos", "line")))).alias("_lines"), (F.min("pos") + 1).cast("long").alias("line_start"), F.max(F.when(~blank, F.col("pos") + 1)).cast("long").alias("line_end")
    )
    name = F.substring(F.regexp_replace(F.get("_lines", F.lit(0))["line"], BLANK_ENDS, ""), 1, NAME_CHARS)
    preview = F.array_join(F.transform(F.slice("_lines", 1, PREVIEW_LINES), lambda x: x["line"]), "\n")
    none = F.lit(None).cast("string")
    return sections.filter(F.size("_lines") > 0).select(
        "path", name.alias("symbol_name"), name.alias("qualified_name"), F.lit("section").alias("symbol_kind"), none.alias("signature"), none.alias("doc_comment"), preview.alias("body_preview"), "line_start", "line_end"
    )


def preview_of(lines: list[str]) -> str | None:
    return "\n".join([x for x in lines if x.strip()][:PREVIEW_LINES]) or None


def python_symbols(text: str) -> list[tuple]:
    """Functions, classes and methods of a Python file; none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.split("\n"), []

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if owner else "function"
                body = child.body[0].lineno - 1
                signature = " ".join(x.strip() for x in lines[child.lineno - 1 : max(child.lineno, body)]).strip()
                signature = re.sub(r"[\s{:]+$", "", signature if body >= child.lineno else signature.split(":")[0])
                name = f"{owner}.{child.name}" if owner else child.name
                out.append((child.name, name, kind, signature, ast.get_docstring(child), preview_of(lines[child.lineno : child.end_lineno]), child.lineno, child.end_lineno))
                if is_class:
                    visit(child, child.name)

    visit(tree, None)
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of code files; other files give none. Lines count from 1."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
        for rows in batches:
            out = [(path, *x) for path, text in zip(rows["path"], rows["text"], strict=True) for x in python_symbols(text)]
            yield pd.DataFrame(out, columns=columns)

    known = files.select("path", F.coalesce("text", F.lit("")).alias("text"), language_of("path").alias("language"))
    return known.filter("language = 'python'").mapInPandas(work, CHUNK_SCHEMA).unionByName(code_symbols(known))


def chunks_of(files: DataFrame) -> DataFrame:
    """All chunks of files, with ids that a second run gives again."""
    strategy = chunk_strategy(language_of("path"))
    kept = files.filter(~is_excluded("path"))
    named = F.sha2(F.concat_ws("\x1f", "path", "qualified_name", F.col("line_start").cast("string")), 256).alias("id")
    # Sections lie by path already, and a path has one strategy; so each side drops its own duplicates, and sections stay where they are.
    once = lambda rows: rows.select(named, "*").dropDuplicates(["path", "id"])
    both = once(chunk_sections(kept.filter(strategy == "structural"))).unionByName(once(extract_symbols(kept.filter(strategy == "code"))))
    return both.select("id", F.col("path").alias("file_path"), *[c.split()[0] for c in CHUNK_SCHEMA.split(", ")[1:]], language_of("path").alias("language"))


def chunk_vectors(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    text = build_embed_text("symbol_kind", "symbol_name", "file_path", "signature", "doc_comment", "body_preview")
    return embed_text(chunks.select(F.col("id").alias("chunk_id"), "file_path", text.alias("_text")), "_text", embedder).select("chunk_id", "embed_model", "embedding", "file_path")


def tables_of(chunks: DataFrame, history: DataFrame, now, limit: int = LIMIT) -> dict[str, DataFrame]:
    """Chunks with churn and hotspot, their links and the commits of these, from the files' histories."""
    recent = history_commits(history, limit)
    return {
        "links": file_links(chunks, recent),
        "chunks": with_hotspots(chunks.withColumns({"churn_count": F.lit(0), "hotspot_score": F.lit(0.0)}), history_scores(history, now, limit)),
        "bridge": link_chunks(chunks, recent),
        "commits": recent.select("sha", "message", "ts").distinct(),
    }


def history_tables(chunks: DataFrame, changes: DataFrame, now, limit: int = LIMIT, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    return tables_of(chunks, history := held(file_history(changes)), now, limit) | {"history": history}


def build_index(files: DataFrame, changes: DataFrame, embedder: Embedder, now, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All index tables of a tree of files and its history. A file without chunks is in the manifest too. held may write
    the new chunks and the history and read them again, so that files are parsed and changes counted once for all tables.
    Links are by file (path, commit_sha); the bridge has them for each chunk of the file."""
    chunks = held(chunks_of(files))
    return history_tables(chunks, changes, now, held=held) | {"vectors": chunk_vectors(chunks, embedder), "files": files.filter(~is_excluded("path")).select("path", "content_hash")}


def update_index(index: dict[str, DataFrame], files: DataFrame, changes: DataFrame | None, embedder: Embedder, now, partial: bool = False, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The index after files changed: new and changed ones have their chunks, vectors and links replaced, deleted ones lose
    them, others keep theirs. Churn and links follow from the index's own history, merged with changes if there are any.
    partial: files holds only some paths; absent ones aren't deleted. held is as in build_index."""
    history = index["history"] if changes is None else merged_history(index["history"], file_history(changes))
    diff = held(diff_manifest(files.filter(~is_excluded("path")), index["files"]))
    gone = diff.filter(F.col("change").isin("changed", *([] if partial else ["deleted"]))).select(F.col("path").alias("file_path"))
    fresh = files.join(diff.filter("change in ('new', 'changed')").select("path"), "path", "left_semi")
    chunks = held(chunks_of(fresh))
    more = tables_of(chunks, history.join(fresh.select("path"), "path", "left_semi"), now)
    old = index["chunks"].join(gone, "file_path", "left_semi").select(F.col("id").alias("chunk_id"))
    keep = lambda t: index[t].join(gone, "file_path", "left_anti").select(*index[t].columns) if "file_path" in index[t].columns else index[t].join(old, "chunk_id", "left_anti")
    columns = index["chunks"].columns
    links = {}
    if "links" in index:
        renewed = gone.withColumnRenamed("file_path", "path").unionByName(diff.filter("change = 'new'").select("path"))
        links = {"links": index["links"].join(renewed, "path", "left_anti").unionByName(more["links"])}
    return links | {
        "chunks": index["chunks"].join(gone, "file_path", "left_anti").select(*columns).unionByName(more["chunks"].select(*columns)),
        "bridge": keep("bridge").unionByName(more["bridge"]),
        "vectors": keep("vectors").unionByName(chunk_vectors(chunks, embedder).select(*index["vectors"].columns)),
        "commits": index["commits"].unionByName(more["commits"]).dropDuplicates(["sha"]),
        "files": index["files"].join(gone.withColumnRenamed("file_path", "path"), "path", "left_anti").unionByName(fresh.filter(~is_excluded("path")).select("path", "content_hash")),
        "history": history,
    }
