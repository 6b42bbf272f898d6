r"""Symbols of code files in 30 languages, by tokens and scopes, with SQL functions only.

One pattern a language cuts a text into tokens: comments and strings (so that nothing inside them counts), declarations,
brackets or words that open and close a scope, ends of statements, and the plain text between. The tokens of a file are
rows; running sums over them give each its line and its depth. At one depth a scope's end is simply the next row, and a
declaration's body the first scope before the statement ends, so every step is a window over a path, or over a path and
a depth, that is linear in the file's tokens and can spill. A path's rows stay in one partition from first to last.

It is no compiler: a file whose brackets don't match gives what the depths make of it, names built by macros are unseen,
and layout languages (Haskell, Elm, OCaml, Erlang, TLA+) have their declarations at the first column only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREVIEW_LINES = 8
#: What begins each token of a marked text, and what parts its head (code|flags|kind|name) from it; in texts they become blanks.
MARK, THEN = "\x01", "\x02"
RULE, DOC, SKIP, NEUTRAL, BODY, OPEN, CLOSE, STOP, PLAIN, END = "d", "m", "s", "n", "o", "p", "c", "t", "_", "e"

BLOCK = r"/\*(?s:.*?)(?:\*/|\z)"
SLASHES, HASH, DASHES = r"//[^\n]*", r"#[^\n]*", r"--[^\n]*"
# An even number of backslashes before the closing quote; nothing here makes the matcher recurse on long strings.
QUOTED = r'"[^\n]*?(?<!\\)(?:\\\\)*"'
LONG_QUOTED = r'"(?s:.*?)(?<!\\)(?:\\\\)*"'
SINGLE = r"'[^\n]*?(?<!\\)(?:\\\\)*'"
LONG_SINGLE = r"'(?s:.*?)(?<!\\)(?:\\\\)*'"
CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
TRIPLE, TRIPLE_SINGLE, BACKTICK = r'"""(?s:.*?)"""', r"'''(?s:.*?)'''", r"`(?s:.*?)`"
HEREDOC = r"<<[-~]?[\"']?(?<h>[A-Za-z_]\w*)[\"']?[^\n]*\n(?s:.*?)\n[ \t]*\k<h>\b"
PHP_HEREDOC = r"<<<[ \t]*[\"']?(?<h>\w+)[\"']?\n(?s:.*?)\n[ \t]*\k<h>\b"

ATTRIBUTE = r"^[ \t]*(?:#!?\[[^\n]*\]|\[[A-Z][^\n]*\]|@[\w.]+(?:\([^\n]*\))?)[ \t]*$"
BRACES, OTHERS, CLOSERS = r"\{", r"[(\[]", r"[)\]}]"
SEMICOLON = ";"
#: The end of a line, unless the next one goes on with the declaration.
LINE_END = r"\n(?!\s*(?:\{|where\b|extends\b|implements\b|with\b|when\b|do\b|throws\b|[:,.]|->|=>))"
FIRST_COLUMN = r"^(?!end\b|;;)[^\s)\]}]"
WORD = r"[A-Za-z_]\w*"


@dataclass
class Rule:
    """A declaration: `before` and `name` are the token, `after` must follow. Flags: s opens a scope itself, b needs no
    body, x ends where the statement does, o owns what is declared in it, m is a method inside an owner, n counts only
    inside an owner, h isn't a symbol itself."""

    kind: str
    before: str
    name: str = WORD
    after: str = ""
    flags: str = ""


@dataclass
class Language:
    rules: list[Rule]
    comments: list[str] = field(default_factory=lambda: [SLASHES, BLOCK])
    strings: list[str] = field(default_factory=lambda: [QUOTED, CHAR])
    body: str = BRACES
    opens: str = OTHERS
    closes: str = CLOSERS
    stops: str = SEMICOLON
    attribute: str = ATTRIBUTE
    heredoc: str = ""
    skips: list[str] = field(default_factory=list)
    between: str = "."
    owner: str = ""


def modifiers(words: str) -> str:
    return rf"^[ \t]*(?:(?:{words})[ \t]+)*"


NOT_TYPES = r"(?!(?:return|else|if|for|while|switch|case|goto|typedef|using|namespace|throw|delete|new|do|await|yield|import|export|package|in|is|var|let|final|const)\b)"
TYPED = r"^[ \t]*" + NOT_TYPES + r"[A-Za-z_][\w:<>,*&~?.\[\] \t]*?[ \t*&:\]>]"
JS_METHOD = Rule("method", modifiers("public|private|protected|static|async|readonly|get|set|override") + r"\*?(?!(?:if|for|while|switch|return|catch|function)\b)", r"[\w$#]+", r"\s*(?:<[^>\n]*>)?\(", "n")
JS_RULES = [
    Rule("function", modifiers("export|default|async") + r"function\b[ \t]*\*?[ \t]*", r"[\w$]+", r"\s*[<(]"),
    Rule("class", modifiers("export|default|abstract|declare") + r"class[ \t]+", r"[\w$]+", "", "o"),
    Rule("function", modifiers("export") + r"const[ \t]+", r"[\w$]+", r"\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)[^=\n]*|\w+\s*)=>", "b"),
]
TS_RULES = [
    *JS_RULES,
    Rule("interface", modifiers("export|declare|default") + r"interface[ \t]+", r"[\w$]+"),
    Rule("enum", modifiers("export|const|declare") + r"enum[ \t]+", r"[\w$]+"),
    Rule("type", modifiers("export|declare") + r"type[ \t]+", r"[\w$]+", r"\s*(?:<[^=\n]*>)?\s*=", "x"),
]
JS = {"strings": [QUOTED, SINGLE, BACKTICK], "stops": f"{SEMICOLON}|{LINE_END}"}
NEWLINES = {"stops": f"{SEMICOLON}|{LINE_END}"}
COLUMN = {"body": r"(?!)", "opens": r"(?!)", "closes": r"(?!)", "stops": FIRST_COLUMN, "attribute": ""}
C_SKIPS = [r"^[ \t]*#[^\n]*"]
C_STRUCT = Rule("struct", modifiers("typedef|static|const|volatile") + r"struct[ \t]+", WORD, r"[^;{()=]*\{")
C_FUNCTION = Rule("function", TYPED, WORD, r"\s*\(", "m")
JVM_METHOD = r"^[ \t]*" + NOT_TYPES + r"[A-Za-z_][\w<>\[\],.? \t]*?[ \t\]>]"
ENDS = r"(?<![.:\w@$])end\b(?![:?!])"

LANGUAGES = {
    "rust": Language(
        [
            Rule("function", r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:const|async|unsafe|default|extern(?:[ \t]+\"[^\"\n]*\")?)[ \t]+)*fn[ \t]+", WORD, "", "m"),
            Rule("struct", r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?struct[ \t]+", WORD, "", "b"),
            Rule("enum", r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?enum[ \t]+"),
            Rule("interface", r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+", WORD, "", "o"),
            Rule("scope", r"^[ \t]*(?:unsafe[ \t]+)?impl\b[ \t]*(?:<[^{\n]*?>[ \t]+)?(?:[^{\n]*?[ \t]for[ \t]+)?&?(?:\w+::)*", WORD, "", "oh"),
        ],
        strings=[r'r#"(?s:.*?)"#', LONG_QUOTED, CHAR],
        between="::",
    ),
    "typescript": Language([*TS_RULES, JS_METHOD], **JS),
    "tsx": Language([*TS_RULES, JS_METHOD], **JS),
    "javascript": Language([*JS_RULES, JS_METHOD], **JS),
    "go": Language(
        [
            Rule("method", r"^func[ \t]*\([^)\n]*\)[ \t]*", WORD, "", "b"),
            Rule("function", r"^func[ \t]+", WORD, "", "b"),
            Rule("struct", r"^type[ \t]+", WORD, r"(?:\[[^\]\n]*\])?[ \t]+struct\b"),
            Rule("interface", r"^type[ \t]+", WORD, r"(?:\[[^\]\n]*\])?[ \t]+interface\b"),
            Rule("type", r"^type[ \t]+", WORD, "", "b"),
        ],
        strings=[QUOTED, CHAR, BACKTICK],
        skips=[r"\b(?:interface|struct)\{\}"],
        owner=r"^func[ \t]*\([ \t]*(?:\w+[ \t]+)?\*?(\w+)",
        **NEWLINES,
    ),
    "java": Language(
        [
            Rule("class", modifiers("public|private|protected|static|final|abstract|sealed") + r"class[ \t]+", WORD, "", "o"),
            Rule("interface", modifiers("public|private|protected|static|sealed") + r"interface[ \t]+", WORD, "", "o"),
            Rule("enum", modifiers("public|private|protected|static") + r"enum[ \t]+", WORD, "", "o"),
            Rule("method", JVM_METHOD, WORD, r"\s*\(", "nb"),
        ],
        strings=[TRIPLE, QUOTED, CHAR],
    ),
    "c": Language([C_STRUCT, C_FUNCTION], skips=C_SKIPS, attribute=""),
    "cpp": Language(
        [C_STRUCT, Rule("class", modifiers("final") + r"class[ \t]+", WORD, r"[^;{()=]*\{", "o"), C_FUNCTION],
        strings=[r'R"\((?s:.*?)\)"', QUOTED, CHAR], skips=C_SKIPS, attribute="", between="::", owner=r"(\w+)::~?\w+$",
    ),
    "bash": Language(
        [Rule("function", r"^[ \t]*(?:function[ \t]+)?", r"[\w:.-]+", r"[ \t]*\([ \t]*\)\s*\{"), Rule("function", r"^[ \t]*function[ \t]+", r"[\w:.-]+", r"\s*\{")],
        comments=[r"(?<![^\s;])#[^\n]*"], strings=[LONG_QUOTED, r"'[^']*'"], opens=r"(?!)", closes=r"\}", stops=r"(?!)", attribute="", heredoc=HEREDOC,
    ),
    "ruby": Language(
        [
            Rule("method", r"^[ \t]*(?:(?:private|public|protected|module_function)[ \t]+)?def[ \t]+(?:self\.|\w+\.)?", r"\w+[?!=]?", r"(?![^\n]*\)[ \t]*=[^=])(?![ \t]*=[ \t])", "s"),
            Rule("class", r"^[ \t]*class[ \t]+(?:\w+::)*", r"[A-Z]\w*", "", "so"),
            Rule("module", r"^[ \t]*module[ \t]+(?:\w+::)*", r"[A-Z]\w*", "", "so"),
        ],
        comments=[r"^=begin(?s:.*?)^=end", HASH], strings=[LONG_QUOTED, LONG_SINGLE], body=r"(?!)",
        opens=r"[(\[{]|(?:^[ \t]*|(?<=[=(;] )|(?<==))(?:(?:if|unless|case|begin)\b|(?:while|until|for)\b[^\n]*)|\bdo\b(?!:)|\bclass[ \t]*<<", closes=rf"{ENDS}|{CLOSERS}", stops=r"(?!)", attribute="", heredoc=HEREDOC.replace("[-~]?", "[-~]"),
    ),
    "csharp": Language(
        [
            *(Rule(kind, modifiers("public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe") + word + r"[ \t]+", WORD, "", "o") for kind, word in (("class", "class"), ("interface", "interface"), ("struct", "struct"), ("enum", "enum"))),
            Rule("method", JVM_METHOD, WORD, r"(?:<[^>\n]*>)?\s*\(", "nb"),
        ],
        strings=[TRIPLE, r'@"[^"]*"', QUOTED, CHAR], skips=C_SKIPS,
    ),
    "php": Language(
        [
            Rule("function", modifiers("public|private|protected|static|final|abstract") + r"function[ \t]+&?", WORD, r"\s*\(", "mb"),
            Rule("class", modifiers("final|abstract|readonly") + r"class[ \t]+", WORD, "", "o"),
            Rule("scope", r"^[ \t]*(?:interface|trait)[ \t]+", WORD, "", "oh"),
        ],
        comments=[SLASHES, r"#(?!\[)[^\n]*", BLOCK], strings=[LONG_QUOTED, LONG_SINGLE], heredoc=PHP_HEREDOC,
    ),
    "scala": Language(
        [
            Rule("function", modifiers(r"override|private|protected|final|implicit|inline|lazy") + r"def[ \t]+", r"[\w$]+", "", "b"),
            Rule("class", modifiers("case|abstract|final|sealed|implicit|private") + r"class[ \t]+", WORD, "", "bo"),
            Rule("module", modifiers("case|private|implicit") + r"object[ \t]+", WORD, "", "bo"),
            Rule("interface", modifiers("sealed|private") + r"trait[ \t]+", WORD, "", "bo"),
        ],
        strings=[TRIPLE, QUOTED, CHAR], **NEWLINES,
    ),
    "swift": Language(
        [
            Rule("function", modifiers(r"public|private|fileprivate|internal|open|static|class|override|final|mutating|@\w+") + r"func[ \t]+", WORD, r"\s*[<(]", "b"),
            Rule("class", modifiers(r"public|private|fileprivate|internal|open|final|indirect|@\w+") + r"(?:class|struct|enum|actor)[ \t]+(?!func\b|var\b|let\b)", WORD, "", "o"),
            Rule("scope", modifiers("public|private|internal") + r"extension[ \t]+(?:\w+\.)*", WORD, "", "oh"),
            Rule("interface", modifiers("public|private|internal") + r"protocol[ \t]+", WORD, "", "o"),
        ],
        strings=[TRIPLE, QUOTED], **NEWLINES,
    ),
    "elixir": Language(
        [Rule("symbol", r"^[ \t]*def(?:p|macro|macrop)?[ \t]+", r"\w+[?!]?", "", "b"), Rule("scope", r"^[ \t]*defmodule[ \t]+(?:\w+\.)*", WORD, "", "oh")],
        comments=[HASH], strings=[TRIPLE, LONG_QUOTED, SINGLE], body=r"\bdo\b(?!:)", opens=r"[(\[{]|\bfn\b", closes=rf"{ENDS}|{CLOSERS}", stops=LINE_END, attribute=r"^[ \t]*@(?:spec|impl|since)[^\n]*$",
    ),
    "lua": Language(
        [Rule("function", r"^[ \t]*(?:local[ \t]+)?function[ \t]+(?:\w+[.:])*", WORD, "", "s")],
        comments=[r"--\[\[(?s:.*?)\]\]", DASHES], strings=[r"\[\[(?s:.*?)\]\]", QUOTED, SINGLE], body=r"(?!)", opens=r"[(\[{]|\b(?:function|do|if|repeat)\b", closes=r"\b(?:end|until)\b|[)\]}]", stops=r"(?!)", attribute="",
    ),
    "haskell": Language(
        [
            Rule("type", r"^(?:data|newtype|type)[ \t]+(?!family\b|instance\b)", r"[A-Z][\w']*", "", "x"),
            Rule("function", r"^(?!(?:data|newtype|type|class|instance|module|import|where|infix[lr]?|deriving|foreign)\b)", r"[a-z_][\w']*", r"(?![ \t]*(?:::|,))(?=[^\n=]*(?:=|\n[ \t]+[|=]))", "x"),
        ],
        comments=[r"--(?![>|<!#$%&*+./=?@\\^~:])[^\n]*|-- \|[^\n]*", r"\{-(?s:.*?)-\}"], strings=[QUOTED, CHAR], **COLUMN,
    ),
    "nix": Language([Rule("symbol", r"^[ \t]*(?:[\w-]+\.)*", r"[A-Za-z_][\w'-]*", r"\s*=\s*(?:\w+[ \t]*:|\{[^}=]*\}[ \t]*(?:@[ \t]*\w+[ \t]*)?:|\w+[ \t]*@)", "x")], comments=[HASH, BLOCK], strings=[r"''(?s:.*?)''(?![$'\\])", LONG_QUOTED], body=r"(?!)", opens=r"[{(\[]", attribute=""),
    "solidity": Language(
        [
            Rule("function", r"^[ \t]*function[ \t]+", WORD, r"\s*\(", "b"),
            Rule("symbol", r"^[ \t]*(?:abstract[ \t]+)?contract[ \t]+", WORD, "", "o"),
            Rule("scope", r"^[ \t]*(?:interface|library)[ \t]+", WORD, "", "oh"),
            Rule("symbol", r"^[ \t]*event[ \t]+", WORD, r"\s*\(", "b"),
            Rule("symbol", r"^[ \t]*modifier[ \t]+", WORD, "", "b"),
        ],
        strings=[QUOTED, SINGLE],
    ),
    "kotlin": Language(
        [
            Rule("function", modifiers(r"public|private|protected|internal|override|open|abstract|final|suspend|inline|operator|infix|tailrec|external") + r"fun[ \t]+(?:<[^>\n]*>[ \t]*)?(?:[\w<>?]+\.)*", WORD, r"\s*\(", "b"),
            Rule("class", modifiers(r"public|private|protected|internal|open|abstract|final|sealed|data|enum|inner|annotation|value|fun") + r"(?:class|interface)[ \t]+", WORD, "", "bo"),
            Rule("module", modifiers("public|private|internal|data") + r"object[ \t]+", WORD, "", "bo"),
        ],
        strings=[TRIPLE, QUOTED, CHAR], **NEWLINES,
    ),
    "ocaml": Language(
        [
            Rule("symbol", r"^(?:let|and)[ \t]+(?:rec[ \t]+)?", r"[a-z_][\w']*", "", "x"),
            Rule("type", r"^type[ \t]+(?:nonrec[ \t]+)?(?:'\w+[ \t]+|\([^)\n]*\)[ \t]*)?", r"[a-z_][\w']*", "", "x"),
            Rule("module", r"^module[ \t]+(?!type\b)(?:rec[ \t]+)?", r"[A-Z][\w']*", "", "x"),
        ],
        comments=[r"\(\*(?s:.*?)\*\)"], strings=[LONG_QUOTED, CHAR], **COLUMN,
    ),
    "r": Language([Rule("symbol", r"^[ \t]*", r"[A-Za-z_.][\w.]*", r"[ \t]*(?:<<?-|=)\s*function\b", "b")], comments=[HASH], strings=[LONG_QUOTED, LONG_SINGLE], attribute="", stops=LINE_END),
    "zig": Language([Rule("function", modifiers(r"pub|export|extern|inline|noinline") + r"fn[ \t]+", WORD, r"\s*\(")], comments=[SLASHES], strings=[r"\\\\[^\n]*", QUOTED, CHAR], attribute=""),
    "erlang": Language([Rule("function", r"^", r"[a-z]\w*", r"\(", "x")], comments=[r"%[^\n]*"], strings=[LONG_QUOTED, SINGLE], **COLUMN),
    "ql": Language(
        [
            Rule("class", modifiers("private|abstract|final|cached|deprecated") + r"class[ \t]+", WORD, "", "o"),
            # Predicates outside classes are named after them too: fixed by the table of kinds.
            Rule("class", r"^(?!(?:import|from|where|select|class|module)\b)(?:(?:private|cached|deprecated|pragma\[\w+\])[ \t]+)*(?:predicate|[\w:.]+)[ \t]+", WORD, r"\s*\("),
        ],
        strings=[QUOTED],
    ),
    "elm": Language(
        [
            Rule("type", r"^type[ \t]+(?:alias[ \t]+)?", r"[A-Z]\w*", "", "x"),
            Rule("symbol", r"^(?!(?:type|module|import|port|effect)\b)", r"[a-z]\w*", r"(?![ \t]*:)(?=[^\n]*=)", "x"),
        ],
        comments=[DASHES, r"\{-(?s:.*?)-\}"], strings=[TRIPLE, QUOTED, CHAR], **COLUMN,
    ),
    "powershell": Language([Rule("function", r"^[ \t]*(?i:function|filter)[ \t]+(?:\w+:)?", r"[\w-]+")], comments=[r"<#(?s:.*?)#>", r"(?<![^\s;])#[^\n]*"], strings=[r'@"(?s:.*?)\n"@', r'"(?:[^"`]|`(?s:.))*+"', r"'[^']*'"], attribute=""),
    "dart": Language(
        [
            Rule("class", modifiers("abstract|sealed|base|final|interface|mixin") + r"class[ \t]+", WORD, "", "o"),
            Rule("symbol", modifiers("base") + r"mixin[ \t]+(?!class\b)", WORD, "", "o"),
            Rule("function", modifiers("static|external") + TYPED.removeprefix(r"^[ \t]*"), WORD, r"(?:<[^>\n]*>)?\s*\(", "b"),
        ],
        strings=[TRIPLE, TRIPLE_SINGLE, QUOTED, SINGLE],
    ),
    "objc": Language(
        [Rule("class", r"^[ \t]*@(?:interface|implementation)[ \t]+", WORD, "", "s"), Rule("interface", r"^[ \t]*@protocol[ \t]+", WORD, r"(?![^\n]*;)", "s")],
        strings=[QUOTED, CHAR], skips=C_SKIPS, attribute="", opens=r"[(\[]", closes=r"@end\b|[)\]}]",
    ),
    "tlaplus": Language(
        [Rule("symbol", r"^(?:LOCAL[ \t]+)?", r"\w+", r"(?:\([^)\n]*\))?[ \t]*==", "x"), Rule("function", r"^", r"\w+", r"\[[^\]\n]*\][ \t]*==", "x")],
        comments=[r"\\\*[^\n]*", r"\(\*(?s:.*?)\*\)"], strings=[QUOTED], **COLUMN,
    ),
}


def pattern_of(language: Language) -> tuple[str, str]:
    """A pattern with a group for each kind of token, and one for each rule's name; and the replacement that marks them."""
    comment = "|".join(language.comments)
    parts = [(DOC, rf"^[ \t]*(?:{comment})")]
    if language.attribute:
        parts.append((NEUTRAL, language.attribute))
    parts.append((SKIP, "|".join([comment, *language.strings, *language.skips])))
    parts += [(r, rf"{r.before}({r.name})(?!\w)" + (rf"(?={r.after})" if r.after else "")) for r in language.rules]
    parts += [(CLOSE, language.closes), (BODY, language.body), (OPEN, language.opens), (STOP, language.stops)]
    if language.heredoc:
        parts.append((SKIP, language.heredoc))  # last, since it has a group of its own
    marks, group = "", 1
    for of, _ in parts:
        if isinstance(of, Rule):
            marks += f"{MARK}{RULE}|{of.flags}|{of.kind}|${group + 1}{THEN}${group}"
            group += 2
        else:
            marks += f"{MARK}{of}|||{THEN}${group}"
            group += 1
    return "(?m)" + "|".join(f"({p})" for _, p in parts), f"{marks}{MARK}{PLAIN}|||{THEN}"


def chosen(by: list[tuple[Column, Column]]) -> Column:
    """One flat case expression."""
    out = F.when(*by[0])
    for condition, value in by[1:]:
        out = out.when(condition, value)
    return out


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def tokens_of(files: DataFrame) -> DataFrame:
    """(path, language, n, code, flags, kind, name, token, line, at): every token of every file, with its first line and
    its offset, both from 1."""
    marked = chosen([(F.col("language") == name, F.regexp_replace("text", *map(F.lit, pattern_of(language)))) for name, language in LANGUAGES.items()])
    cut = F.filter(F.split(F.concat(F.lit(f"{MARK}{PLAIN}|||{THEN}"), marked), MARK), lambda x: (x != "") & ~x.endswith(THEN))
    rows = files.select("path", "language", F.posexplode(cut).alias("n", "_t"))
    head = F.split(F.substring_index("_t", THEN, 1), r"\|")
    rows = rows.select("path", "language", "n", *(head[i].alias(c) for i, c in enumerate(("code", "flags", "kind", "name"))), F.expr(f"substring(_t, instr(_t, '{THEN}') + 1)").alias("token"))
    before = W.partitionBy("path").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns({"line": F.coalesce(F.sum(newlines(F.col("token"))).over(before), F.lit(0)) + 1, "at": F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)) + 1})


def code_symbols(files: DataFrame) -> DataFrame:
    """(path, symbol_name, qualified_name, symbol_kind, signature, doc_comment, body_preview, line_start, line_end) of
    files (path, text, language), one row a path. Null texts are empty; other languages give none."""
    # A number of partitions, since texts become many more rows than their size tells.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = files.filter(F.col("language").isin(*LANGUAGES)).select("path", F.translate(F.coalesce("text", F.lit("")), MARK + THEN, "  ").alias("text"), "language").repartition(parts, "path")
    in_path = W.partitionBy("path").orderBy("n")
    so_far = in_path.rowsBetween(W.unboundedPreceding, 0)
    earlier = in_path.rowsBetween(W.unboundedPreceding, -1)

    token, code = F.col("token"), F.col("code")
    opens = code.isin(BODY, OPEN) | F.col("flags").contains("s")
    trimmed = F.regexp_replace(token, r"\s+$", "")
    new_line = (code == STOP) & (token == "\n")
    neutral = (code == NEUTRAL) | ((code == PLAIN) & (F.trim(F.replace(token, F.lit("\n"), F.lit(" "))) == "") & (newlines(token) < 2)) | (new_line & ~F.coalesce(F.lag(new_line).over(in_path), F.lit(False)))
    rows = tokens_of(known).withColumns(
        {
            "rule": code == RULE,
            "opens": opens,
            "depth": F.sum(F.when(opens, 1).when(code == CLOSE, -1).otherwise(0)).over(so_far) - opens.cast("int"),
            "content_end": F.when(trimmed != "", F.col("line") + newlines(trimmed)),
            # Comments have the number of the first row after them that is neither comment nor blank: groups are short.
            "doc": F.coalesce(F.sum(F.when((code == DOC) | neutral, 0).otherwise(1)).over(earlier), F.lit(0)),
        }
    ).withColumns({"previous_end": F.coalesce(F.last("content_end", ignorenulls=True).over(earlier), F.lit(1)), "file_end": F.max("content_end").over(W.partitionBy("path"))})

    # A closing bracket ends the inner scope as well, so that nothing in it looks for its end outside.
    layout = F.col("language").isin(*(name for name, x in LANGUAGES.items() if x.stops == FIRST_COLUMN))
    comments = F.collect_list(F.when(code == DOC, F.struct("n", F.trim("token").alias("t")))).over(W.partitionBy("path", "doc"))
    needed = rows.filter(F.col("rule") | F.col("opens") | code.isin(CLOSE, STOP, DOC)).withColumn("comments", F.when(F.col("rule"), comments)).filter(layout | (code != DOC))
    placed = needed.withColumn("_at", F.explode(F.when(code == CLOSE, F.array(F.struct(F.col("depth").alias("d"), code.alias("c")), F.struct((F.col("depth") + 1).alias("d"), F.lit(END).alias("c")))).otherwise(F.array(F.struct(F.col("depth").alias("d"), code.alias("c"))))))
    placed = placed.select("path", "language", "n", "token", "line", "at", "flags", "kind", "name", "rule", "opens", "comments", "previous_end", "file_end", F.col("_at.d").alias("depth"), F.col("_at.c").alias("code"))
    at_depth = W.partitionBy("path", "depth").orderBy("n")
    closed = placed.withColumns({"closed_n": F.when(F.col("opens"), F.lead("n").over(at_depth)), "closed_line": F.when(F.col("opens"), F.lead("line").over(at_depth))})
    # What ends a declaration or begins its body; brackets of parameters don't count.
    event = F.when(~F.col("code").isin(OPEN, CLOSE) & ~(F.col("flags").contains("s") & ~F.col("rule")), F.struct("code", "line", "n", "at", "closed_n", "closed_line", "previous_end"))
    following = W.partitionBy("path", "depth").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    found = closed.withColumn("next", F.last(event, ignorenulls=True).over(following)).filter("rule")

    own, whole = F.col("flags").contains("s"), F.col("flags").contains("x")
    has_body = ~own & ~whole & F.coalesce(F.col("next.code") == BODY, F.lit(False))
    stop = F.col("next.code") == STOP
    stop_line = F.when(stop & ~layout, F.col("next.line")).otherwise(F.coalesce("next.previous_end", "file_end"))
    declared = found.filter(own | whole | has_body | F.col("flags").contains("b")).select(
        "path", "language", "code", "n", "at", "line", "flags", "depth", "comments", "token",
        F.when(own, F.col("n")).when(has_body, F.col("next.n")).alias("body_n"),
        F.when(own, F.coalesce("closed_n", F.lit(2**31 - 1))).when(has_body, F.coalesce("next.closed_n", F.lit(2**31 - 1))).alias("closed_n"),
        F.when(has_body, F.col("next.at")).when(~own & ~layout & stop & (F.col("token") != ""), F.col("next.at")).alias("head_end"),
        F.col("next.line").alias("head_line"),
        F.greatest(F.col("line"), F.when(own, F.coalesce("closed_line", "file_end")).when(has_body, F.coalesce("next.closed_line", "file_end")).otherwise(stop_line)).alias("line_end"),
        "kind",
        F.col("name").alias("symbol_name"),
        receiver().alias("receiver"),
    )

    # At a depth, owners' scopes don't overlap: the last one begun either holds a row or none does.
    scopes = declared.filter(F.col("flags").contains("o") & F.col("body_n").isNotNull()).select("path", (F.col("depth") + 1).alias("depth"), F.col("body_n").alias("n"), F.struct("symbol_name", "closed_n").alias("scope"))
    both = declared.withColumn("scope", F.lit(None).cast(scopes.schema["scope"].dataType)).unionByName(scopes, allowMissingColumns=True)
    last = F.last("scope", ignorenulls=True).over(W.partitionBy("path", "depth").orderBy("n", F.col("scope").isNotNull()).rowsBetween(W.unboundedPreceding, -1))
    owned = both.withColumn("_last", last).filter("code is not null").withColumn("owner", F.coalesce("receiver", F.when(F.col("_last.closed_n") > F.col("n"), F.col("_last.symbol_name"))))
    kept = owned.filter(~F.col("flags").contains("h") & ~(F.col("flags").contains("n") & F.col("owner").isNull()))

    between = F.when(F.col("language").isin(*(n for n, x in LANGUAGES.items() if x.between == "::")), "::").otherwise(".")
    lines = F.col("lines")
    first = F.get(lines, (F.col("line") - 1).cast("int"))
    # A declaration's token begins with its line.
    heading = F.array_join(F.slice(lines, F.col("line").cast("int"), F.greatest(F.col("head_line") - F.col("line") + 1, F.lit(0)).cast("int")), "\n")
    head = F.when(F.col("head_end").isNotNull(), heading.substr(F.lit(1), (F.col("head_end") - F.col("at")).cast("int"))).otherwise(first)
    body = F.filter(F.slice(lines, (F.col("line") + 1).cast("int"), (F.col("line_end") - F.col("line")).cast("int")), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))) != "")
    preview = F.array_join(F.slice(body, 1, PREVIEW_LINES), "\n")
    return (
        kept.join(known.select("path", F.split("text", "\n").alias("lines")), "path")
        .select(
            "path",
            "symbol_name",
            F.when(F.col("owner").isNotNull(), F.concat("owner", between, "symbol_name")).otherwise(F.col("symbol_name")).alias("qualified_name"),
            F.when(F.col("owner").isNotNull() & F.col("flags").contains("m"), "method").otherwise(F.col("kind")).alias("symbol_kind"),
            F.regexp_replace(F.trim(F.regexp_replace(head, r"\s+", " ")), r"[\s{:;]+$", "").alias("signature"),
            F.when(F.size("comments") > 0, F.array_join(F.transform(F.array_sort("comments"), lambda x: x["t"]), "\n")).alias("doc_comment"),
            F.when(preview != "", preview).alias("body_preview"),
            F.col("line").cast("long").alias("line_start"),
            F.col("line_end").cast("long").alias("line_end"),
        )
    )


def receiver() -> Column:
    """The owner that a declaration itself names."""
    found = chosen([(F.col("language") == language, F.regexp_extract("token", x.owner, 1)) for language, x in LANGUAGES.items() if x.owner])
    return F.when(found != "", found)
