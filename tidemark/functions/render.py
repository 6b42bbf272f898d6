"""Column functions that write a hit, a note or a symbol as text. Timestamps show their date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import col, doc_line

#: The line that says that a text was cut.
NOTICE = "[output truncated to fit budget]"
#: Decimals to which a number is rounded before it is printed.
EXACT = 9


def fixed(x, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.bround(F.round(col(x), EXACT), places))


def date_of(t) -> Column:
    return F.substring(col(t).cast("string"), 1, 10)


def render_compact(stale, type_, importance, score, id_, created, length, title) -> Column:
    mark = F.when(col(stale), "[stale?] ").otherwise("")
    kind = F.when(F.length(col(type_)) < 18, F.rpad(col(type_), 18, " ")).otherwise(col(type_))
    return F.concat(mark, F.lit("["), kind, F.lit(" "), fixed(importance, 2), F.lit("] "), fixed(score, 3), F.lit("  "), col(id_), F.lit("  "), date_of(created), F.lit("  ~"), col(length).cast("string"), F.lit("c  "), col(title), F.lit("\n"))


def render_summary(compact, facts, tags) -> Column:
    """A compact line, then facts and tags with a blank line after them, if there are any."""
    none = F.array().cast("array<string>")
    facts, tags = F.coalesce(col(facts), none), F.coalesce(col(tags), none)
    said = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("  - "), f, F.lit("\n"))), "")
    tagged = F.when(F.size(tags) > 0, F.concat(F.lit("  tags: "), F.array_join(tags, ", "), F.lit("\n"))).otherwise("")
    return F.concat(col(compact), said, tagged, F.when((F.size(facts) > 0) | (F.size(tags) > 0), "\n").otherwise(""))


def render_full(type_, importance, title, id_, created, tags, content, facts) -> Column:
    listed = lambda c, name, between: F.when(F.size(col(c)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(col(c), between), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("["), col(type_), F.lit(" "), fixed(importance, 2), F.lit("] "), col(title), F.lit("\nid: "), col(id_), F.lit(" | "), date_of(created), F.lit("\n"))
    return F.concat(head, listed(tags, "tags", ", "), col(content), F.lit("\n"), listed(facts, "facts", "; "), F.lit("---\n"))


def render_code(kind, score, path, start, end, duplicates, qualified, signature, doc, churn, hotspot, history, verbose: bool = True) -> Column:
    more = F.when(col(duplicates) > 0, F.concat(F.lit("  (+"), col(duplicates).cast("string"), F.lit(" duplicates)"))).otherwise("")
    head = F.concat(F.lit("["), col(kind), F.lit("] "), fixed(score, 3), F.lit("  "), col(path), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"), more, F.lit(" "), col(qualified), F.lit("\n"))
    line = lambda c, name: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\n")), F.lit(""))
    quoted = F.array_join(F.transform(col(history), lambda m: F.concat(F.lit('"'), m, F.lit('"'))), ", ")
    return F.concat(
        head,
        line(col(signature), "Signature"),
        line(doc_line(doc, ("///", "//!")), "Doc") if verbose else F.lit(""),
        F.when(col(churn) > 0, F.concat(F.lit("Churn: "), col(churn).cast("string"), F.lit(" commits\n"))).otherwise(""),
        F.when(col(hotspot) > 0.01, F.concat(F.lit("Hotspot: "), fixed(hotspot, 2), F.lit("\n"))).otherwise(""),
        F.when(F.size(col(history)) > 0, line(quoted, "History")).otherwise(""),
    )


def truncate_to_budget(c, budget: int, notice: str = NOTICE) -> Column:
    """A text of at most budget bytes as it is; else cut there, not inside a character, and then at its last line
    break, with a notice after it. Without a line break there is no notice."""
    cut = F.make_valid_utf8(F.substring(F.encode(col(c), "utf-8"), 1, budget).cast("string"))
    cut = F.when(col(c).startswith(cut), cut).otherwise(F.regexp_replace(cut, "\ufffd$", ""))
    lines = F.concat(F.regexp_replace(cut, r"\n[^\n]*\z", ""), F.lit("\n" + notice + "\n"))
    return F.when(F.octet_length(col(c)) <= budget, col(c)).when(cut.contains("\n"), lines).otherwise(cut)
