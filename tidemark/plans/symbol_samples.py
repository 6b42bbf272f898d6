"""Small files in every language that symbols are found in, with what is to be found: traps are brackets and end words in
strings and comments. `§` stands for a number, `^` for any text of one line without quotes.

By ending: the file, and (name, qualified name, kind, first line, last line) of each symbol.
"""

SAMPLES = {
    "rs": ('/// ^ }\nfn f§(a: &\'static str) -> i32 {\n    let s = "} // ^";\n    let c = \'{\';\n    /* } */\n    1\n}\nimpl Shape for P {\n    fn area(&self) -> i32 {\n        1\n    }\n}\nstruct U(u8);\n', [("f§", "f§", "function", 2, 7), ("area", "P::area", "method", 9, 11), ("U", "U", "struct", 13, 13)]),
    "ts": ("// ^\nexport class C§ {\n  run(a: number): void {\n    if (a) { return }\n    const s = `}\n} ^`\n  }\n}\ntype T = { a: string }\n", [("C§", "C§", "class", 2, 8), ("run", "C§.run", "method", 3, 7), ("T", "T", "type", 9, 9)]),
    "tsx": ("export interface P§ {\n  a: string // } ^\n}\nexport const v = (p: P) => {\n  return <b>{p.a}</b>\n}\n", [("P§", "P§", "interface", 1, 3), ("v", "v", "function", 4, 6)]),
    "js": ("async function go§(a) {\n  call(a, { b: '}' })\n  // ^ }\n}\n", [("go§", "go§", "function", 1, 4)]),
    "go": ("// ^\nfunc (s *Server) Run§(x interface{}) error {\n\tq := `}`\n\treturn nil\n}\n\ntype T struct {\n\ta int\n}\n", [("Run§", "Server.Run§", "method", 2, 5), ("T", "T", "struct", 7, 9)]),
    "java": ('public class A§\n    extends B {\n  /** ^ */\n  @Override\n  public List<String> get(int a) {\n    String s = """\n  }\n""";\n    return foo(1);\n  }\n}\n', [("A§", "A§", "class", 1, 11), ("get", "A§.get", "method", 5, 10)]),
    "c": ("/* ^ } */\nstatic int *add§(int a,\n   int b)\n{\n  char c = '{';\n  return foo(a);\n}\nint proto(int);\nstruct P {\n  int x;\n};\n", [("add§", "add§", "function", 2, 7), ("P", "P", "struct", 9, 11)]),
    "cpp": ('class A§ : public B {\n public:\n  int get() const { return 1; }\n};\nint A::set(int x) {\n  auto s = R"(})";\n  return x; // ^ }\n}\n', [("A§", "A§", "class", 1, 4), ("get", "A§::get", "method", 3, 3), ("set", "A::set", "method", 5, 8)]),
    "sh": ('foo§() {\n  cat <<EOF\n} ^\nEOF\n  echo "${x}" # }\n}\nfunction bar {\n  case $1 in a) echo;; esac\n}\n', [("foo§", "foo§", "function", 1, 6), ("bar", "bar", "function", 7, 9)]),
    "rb": ('class A§ < B\n  # ^ end\n  def m(x)\n    if x\n      return 1 if x\n    end\n    xs.each do |y|\n      z = "end"\n    end\n  end\nend\n', [("A§", "A§", "class", 1, 11), ("m", "A§.m", "method", 3, 10)]),
    "cs": ("namespace N {\n  public class A§ {\n    /// ^\n    public int Get(int a) => a + 1;\n    private async Task<int> Run()\n    {\n      return await Foo(1);\n    }\n  }\n}\n", [("A§", "A§", "class", 2, 9), ("Get", "A§.Get", "method", 4, 4), ("Run", "A§.Run", "method", 5, 8)]),
    "php": ("<?php\nfunction f§($a) {\n  return '} ^';\n}\nfinal class A {\n  # c }\n  public static function m(): int {\n    return 1;\n  }\n}\n", [("f§", "f§", "function", 2, 4), ("A", "A", "class", 5, 10), ("m", "A.m", "method", 7, 9)]),
    "scala": ('object O§ {\n  def f(x: Int): Int = {\n    x // ^ }\n  }\n  def g = 1\n}\ntrait T {\n  def h: Int\n}\n', [("O§", "O§", "module", 1, 6), ("f", "O§.f", "function", 2, 4), ("g", "O§.g", "function", 5, 5), ("T", "T", "interface", 7, 9), ("h", "T.h", "function", 8, 8)]),
    "swift": ('class A§: B {\n  func f(x: Int) -> Int {\n    return "} ^"\n  }\n}\nprotocol P {\n  func g()\n}\n', [("A§", "A§", "class", 1, 5), ("f", "A§.f", "function", 2, 4), ("P", "P", "interface", 6, 8), ("g", "P.g", "function", 7, 7)]),
    "ex": ("defmodule M.N§ do\n  # ^ end\n  def f(x) do\n    if x do\n      1\n    end\n  end\n\n  defp g(x), do: x\nend\n", [("f", "N§.f", "symbol", 3, 7), ("g", "N§.g", "symbol", 9, 9)]),
    "lua": ('-- ^ end\nfunction f§(a)\n  if a then\n    for i=1,2 do\n      x = "end"\n    end\n  end\nend\nlocal function g() return 1 end\n', [("f§", "f§", "function", 2, 8), ("g", "g", "function", 9, 9)]),
    "hs": ("data T§ = A\n  | B\n\n-- ^\nf :: Int -> Int\nf n\n  | n > 1 = 2\n  | otherwise = 3\n", [("T§", "T§", "type", 1, 2), ("f", "f", "function", 6, 8)]),
    "nix": ("{ pkgs }:\n{\n  # ^ }\n  f§ = x: y:\n    x + y;\n  g = { a, b }: {\n    c = a;\n  };\n  v = 1;\n}\n", [("f§", "f§", "symbol", 4, 5), ("g", "g", "symbol", 6, 8)]),
    "sol": ("contract C§ {\n  event E(uint a);\n  modifier m() {\n    _;\n  }\n  /// ^ }\n  function f(uint a) public returns (uint) {\n    return a;\n  }\n}\n", [("C§", "C§", "symbol", 1, 10), ("E", "C§.E", "symbol", 2, 2), ("m", "C§.m", "symbol", 3, 5), ("f", "C§.f", "function", 7, 9)]),
    "kt": ('data class P§(val x: Int)\n/** ^ */\nclass A : B() {\n  override fun f(x: Int): Int {\n    return "}"\n  }\n  fun g() = 1\n}\nobject O {\n}\n', [("P§", "P§", "class", 1, 1), ("A", "A", "class", 3, 8), ("f", "A.f", "function", 4, 6), ("g", "A.g", "function", 7, 7), ("O", "O", "module", 9, 10)]),
    "ml": ("(* ^ *)\nlet rec f§ x =\n  x + 1\n\ntype t =\n  | A\n\nmodule M = struct\n  let g = 1\nend\n", [("f§", "f§", "symbol", 2, 3), ("t", "t", "type", 5, 6), ("M", "M", "module", 8, 10)]),
    "r": ("# ^ }\nf§ <- function(a = list()) {\n  '}'\n}\ng = function(x) x + 1\n", [("f§", "f§", "symbol", 2, 4), ("g", "g", "symbol", 5, 5)]),
    "zig": ("/// ^ }\npub fn add§(a: i32) i32 {\n    const s =\n        \\\\ }\n    ;\n    return a;\n}\n", [("add§", "add§", "function", 2, 7)]),
    "erl": ("-module(a).\n%% ^\nf§(0) ->\n  1;\nf§(N) ->\n  N.\n", [("f§", "f§", "function", 3, 4), ("f§", "f§", "function", 5, 6)]),
    "ql": ("import cpp\n\n/** ^ } */\npredicate p§(int x) {\n  x = 1\n}\n\nclass A extends B {\n  int m() { result = 1 }\n}\n", [("p§", "p§", "class", 4, 6), ("A", "A", "class", 8, 10)]),
    "elm": ("type alias R§ =\n    { a : Int }\n\nf : Int -> Int\nf x =\n    x -- ^\n", [("R§", "R§", "type", 1, 2), ("f", "f", "symbol", 5, 6)]),
    "ps1": ('<# ^ } #>\nfunction Get-X§ {\n  param($a)\n  "}"\n}\n', [("Get-X§", "Get-X§", "function", 2, 5)]),
    "dart": ("/// ^ }\nclass A§ extends B {\n  int f(int a, {int b = 1}) {\n    return foo(a);\n  }\n}\nmixin M {\n}\nvoid main() => run();\n", [("A§", "A§", "class", 2, 6), ("f", "A§.f", "function", 3, 5), ("M", "M", "symbol", 7, 8), ("main", "main", "function", 9, 9)]),
    "m": ('@protocol P;\n@interface A§ : B\n- (void)f;\n@end\n@implementation A§\n- (void)f {\n  x = @"@end ^";\n}\n@end\n', [("A§", "A§", "class", 2, 4), ("A§", "A§", "class", 5, 9)]),
    "tla": ("---- MODULE M ----\n\\* ^\nInit§ == x = 0\n\nNext(a) ==\n  x' = 1\n\nf[x \\in S] == 1\n", [("Init§", "Init§", "symbol", 3, 3), ("Next", "Next", "symbol", 5, 6), ("f", "f", "function", 8, 8)]),
}


def found_sql() -> str:
    """(ending, symbol_name, qualified_name, symbol_kind, line_start, line_end) as a SQL list of values."""
    return ", ".join(f"('{end}', '{name}', '{full}', '{kind}', {first}, {last})" for end, (_, found) in SAMPLES.items() for name, full, kind, first, last in found)
