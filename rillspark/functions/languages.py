"""Which programming language a file name has, and how its text is best divided."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and their file suffixes or other names.
LANGUAGES = """
actionscript .as
ada .ada .adb .ads
agda .agda
apex .cls .trigger
arduino .ino
asm .asm .a51 .i .nas .nasm .s
astro .astro
bash .sh .bash
beancount .beancount
bibtex .bib .bibtex
bicep .bicep .bicepparam
bitbake .bb .bbappend .bbclass
c .c .cats .h.in .idc
cairo .cairo
capnp .capnp
chatito .chatito
clarity .clar
clojure .clj .boot .cl2 .cljc .cljs .cljs.hl .cljscm .cljx .hic
cmake .cmake .cmake.in
commonlisp .lisp .asd .cl .l .lsp .ny .podsl .sexp
cpp .cpp .h .c++ .cc .cp .cppm .cxx .h++ .hh .hpp .hxx .inl .ipp .ixx .tcc .tpp .txx c++
cpon .cpon
csharp .cs .cake .cs.pp .csx .linq cs c#
css .css .scss
csv .csv
cuda .cu .cuh
d .d .di
dart .dart
dockerfile .dockerfile .containerfile
dtd .dtd
elisp .el
elixir .ex .exs
elm .elm
embeddedtemplate .ets
erlang .erl .app .app.src .escript .hrl .xrl .yrl
fennel .fnl
firrtl .fir
fish .fish
fortran .f .f90 .f95 .f03 f f90 f95 f03
fsharp .fs .fsi .fsx
func .func
gdscript .gd
gitattributes .gitattributes
gitignore .gitignore
gleam .gleam
glsl .glsl .vert .frag
gn .gn .gni
go .go golang
gomod go.mod
gosum go.sum
graphql .graphql .gql
groovy .groovy .grt .gtpl .gvy .gradle
hack .hack
hare .ha
haskell .hs .hs-boot .hsc
haxe .hx
hcl .hcl .tf
heex .heex
hlsl .hlsl
html .html .htm .hta .html.hl .xht .xhtml
hyprlang .hl
ini .ini .cfg
ispc .ispc
janet .janet
java .java .jav .jsh
javascript .js ._js .bones .cjs .es .es6 .gs .jake .javascript .jsb .jscad .jsfl .jslib .jsm .jspre .jss .jsx .mjs .njs .pac .sjs .ssjs .xsjs .xsjslib js
json .json .4DForm .4DProject .avsc .geojson .gltf .har .ice .JSON-tmLanguage .json.example .jsonl .mcmeta .sarif .tact .tfstate .tfstate.backup .topojson .webapp .webmanifest .yy .yyp
jsonnet .jsonnet
julia .jl
kdl .kdl
kotlin .kt .ktm .kts
latex .tex
linkerscript .ld
llvm .ll
lua .lua .nse .p8 .pd_lua .rbxs .rockspec .wlua
luau .luau
magik .magik
make .mak .make .makefile .mk .mkfile
markdown .md .livemd .markdown .mdown .mdwn .mdx .mkd .mkdn .mkdown .ronn .scd .workbook md
mermaid .mmd
meson meson.build
netlinx .axi
nim .nim .nim.cfg .nimble .nimrod .nims
ninja .ninja
nix .nix
nqc .nqc
pascal .pas .dfm .dpr .lpr .pascal pas dpr delphi
pem .pem
perl .pl .al .cgi .fcgi .perl .ph .plx .pm .psgi .t
pgn .pgn
php .php
po .po
pony .pony
powershell .ps1
prisma .prisma
properties .properties
proto .proto
psv .psv
puppet .pp
purescript .purs
python .py .pyw .pyi .pyx .pxd .pxi
qmljs .qml
r .r
racket .rkt
rbs .rbs
re2c .re
rego .rego
requirements requirements.txt
ron .ron
rst .rst
ruby .rb
rust .rs rs
scala .scala
scheme .ss
slang .slang
smali .smali
smithy .smithy
solidity .sol
sparql .sparql
sql .sql
squirrel .nut
starlark .star .bzl
svelte .svelte
swift .swift
tablegen .td
tcl .tcl
thrift .thrift
toml .toml
tsv .tsv
tsx .tsx
twig .twig
typescript .ts ts
typst .typ
udev .rules
ungrammar .ungram
uxntal .tal
verilog .vh
vhdl .vhd .vhdl
vim .vim
vue .vue
wast .wast
wat .wat
wgsl .wgsl
xcompose .xcompose
xml .xml
yaml .yaml .yml
"""


@lru_cache(maxsize=1)
def names() -> dict[str, str]:
    """Language by name or suffix in lower case."""
    rows = [line.split() for line in LANGUAGES.strip().splitlines()]
    return {alias.lower(): row[0] for row in rows for alias in row}


def detect(filename: str | None) -> str | None:
    """The language of a file name by what follows its last dot; None without one, or for an unknown suffix."""
    if filename is None or (dot := filename.rfind(".")) < 0:
        return None
    return names().get(filename[dot:].lower())


def language_of(filename: Column) -> Column:
    """detect() as an expression: a lookup of the suffix in a literal map."""
    entries = [F.lit(x) for pair in names().items() if pair[0].startswith(".") for x in pair]
    return F.try_element_at(F.create_map(*entries), F.lower(F.regexp_extract(filename, r"(?s)(\.[^.]*)$", 1)))


BRACES = (r"\n(?=(?:(?:export|public|private|protected|internal|static|abstract|final|async|default|pub|unsafe|extern)\s+)*(?:class|interface|enum|struct|trait|impl|module|mod|namespace|object|record|protocol|extension|type|func|fn|fun|function|def|const|let|var|val|package|contract|template)\b)", r"\n(?=[^\s}])", r"\n(?=(?:\t|  |    )[^\s}])", r"\n(?=\s*[^\s}])")
TAGS = (r"\n(?=<[A-Za-z!?])", r"\n(?=\s{1,4}<[A-Za-z])", r"(?<=>)\s*(?=<)")
#: Separators of the languages that have a grammar of their own, coarse to fine; the general ones follow.
LADDERS = {
    "python": (r"\n(?=(?:class|def|async\s+def)\b|@)", r"\n(?=[^\s)\]}])", r"\n(?=(?:\t|    )(?:class|def|async\s+def|@))", r"\n(?=(?:\t|    )\S)"),
    "ruby": (r"\n(?=(?:class|module|def)\b)", r"\n(?=\s+(?:class|module|def)\b)"),
    "markdown": (r"\n(?=#\s)", r"\n(?=##\s)", r"\n(?=###\s)", r"\n(?=#{4,6}\s)", r"\n(?=```)"),
    "sql": (r"(?<=;)\s*\n", r"\n(?=(?i:select|from|where|group|order|join|union|with)\b)"),
    "json": (r"(?<=[}\]]),?\s*\n", r",\s*\n"),
    "yaml": (r"\n---\s*\n", r"\n(?=\S)", r"\n(?=  ?\S)"),
    "toml": (r"\n(?=\[)",),
    "html": TAGS, "xml": TAGS, "dtd": (r"\n(?=<!)",), "css": (r"(?<=})\s*\n", r"(?<=;)\s*\n"),
    "fortran": (r"\n(?=\s*(?i:program|module|subroutine|function)\b)",), "pascal": (r"\n(?=(?i:procedure|function|type|var|begin|unit|program)\b)",),
    "r": (r"\n(?=\w+\s*<-\s*function)", r"\n(?=\S)"),
    **dict.fromkeys(("c", "cpp", "csharp", "go", "java", "javascript", "kotlin", "php", "rust", "scala", "solidity", "swift", "tsx", "typescript"), BRACES),
}
