"""File types: names and the file names that belong to them.

A line has a type, its plain extensions, and after an equals sign whole globs.
"""

_TABLE = r"""
license: = *[.-]LICEN[CS]E* AGPL-*[0-9]* APACHE-*[0-9]* BSD-*[0-9]* CC-BY-* COPYING COPYING[.-]* COPYRIGHT COPYRIGHT[.-]* EULA EULA[.-]* GFDL-*[0-9]* GNU-*[0-9]* GPL-*[0-9]* LGPL-*[0-9]* LICEN[CS]E LICEN[CS]E[.-]* MIT-*[0-9]* MPL-*[0-9]* NOTICE NOTICE[.-]* OFL-*[0-9]* PATENTS PATENTS[.-]* UNLICEN[CS]E UNLICEN[CS]E[.-]* agpl[.-]* gpl[.-]* lgpl[.-]* licen[cs]e licen[cs]e.*
readme: = *README README*
docker: = *Dockerfile*
bzip2: bz2 tbz2
lz4: lz4
pants: = BUILD
z: Z
man: = *.[0-9][cEFMmpSx] *.[0-9lnpx]
agda: agda lagda
hare: ha
jinja: jinja2 j2 jinja
vala: vala
lzma: lzma
lua: lua
jupyter: ipynb jpynb
erb: erb
vb: vb
m4: m4 ac
spec: spec
rdoc: rdoc
tf: tfrc terraformrc tf terraform.lock.hcl tf.json tfvars.json tfvars = terraform.rc
zsh: zsh = .zlogin .zlogout .zprofile .zshenv .zshrc zlogin zlogout zprofile zshenv zshrc
sh: bashrc cshrc kshrc sh bash csh tcsh ksh zsh = .bash_login .bash_logout .bash_profile .bashrc .cshrc .kshrc .login .logout .profile .tcshrc .zlogin .zlogout .zprofile .zshenv .zshrc bash_login bash_logout bash_profile bashrc profile zlogin zlogout zprofile zshenv zshrc
vim: vim = .gvimrc .vimrc _gvimrc _vimrc gvimrc vimrc
vimscript: vim = .gvimrc .vimrc _gvimrc _vimrc gvimrc vimrc
asciidoc: adoc asciidoc asc
d: d
scdoc: scdoc scd
candid: did
pod: pod
usd: usda usdc usd
coffeescript: coffee
dvc: dvc = Dvcfile
mk: = mkfile
textile: textile
creole: creole
svelte: svelte
vue: vue
pdf: pdf
twig: twig
zig: zig
yang: yang
log: log
org: org_archive org
svg: svg
diff: diff patch
fish: fish
swig: def i
reasonml: re rei
wiki: wiki mediawiki
config: conf cfg config ini
texinfo: texi
csproj: csproj
k: k
toml: toml = Cargo.lock
json: sarif json = composer.lock
spark: spark
awk: awk
cabal: cabal
tcl: tcl
vcl: vcl
vhdl: vhd vhdl
aidl: aidl
fidl: fidl
webidl: idl webidl widl
elisp: el
bazel: BUILD bazelrc bazel bzl = BUILD MODULE.bazel WORKSPACE WORKSPACE.bazel
julia: jl
jl: jl
dhall: dhall
ml: ml
haml: haml
cml: cml
alire: = alire.toml
qml: qml
sml: sig sml
cshtml: cshtml
ps: psd1 psm1 ps1 ps1xml cdxml
yaml: yaml yml
dockercompose: = docker-compose.yml docker-compose.*.yml
crystal: cr ecr = Projectfile shard.yml
fennel: fnl
jsonl: jsonl
solidity: sol
smarty: tpl
sql: sql psql
erlang: erl hrl
hurl: hurl
wgsl: wgsl
stylus: styl
matlab: m
objc: h m
gleam: gleam
slim: slime skim slim
elm: elm
objcpp: h mm
lean: lean
edn: edn
gn: gni gn
c: cats = *.[chH] *.[chH].in
make: mak mk = [Gg][Nn][Uu]makefile [Gg][Nn][Uu]makefile.am [Gg][Nn][Uu]makefile.in [Mm]akefile [Mm]akefile.am [Mm]akefile.in
cpp: cc hh inl cc.in hh.in = *.[ChH] *.[ChH].in *.[ch]pp *.[ch]pp.in *.[ch]xx *.[ch]xx.in
ceylon: ceylon
lock: lock = package-lock.json
fortran: F90 f90 F95 f95 F77 f77 F f pfo
go: go
mojo: mojo
mako: mao mako
motoko: mo
po: po
qmake: prf pri pro
prolog: P prolog pl pro
protobuf: proto
dita: dita ditaval ditamap
amake: mk bp
puppet: rb erb pp epp
h: h hh hpp
carp: carp
lisp: sc el jl scm lisp lsp
typst: typ
brotli: br
idris: idr lidr
taskpaper: taskpaper
cbor: cbor
gprbuild: gpr
avro: avsc avdl avpr
asm: S asm s
pascal: inc pp dpr lpr pas
flatbuffers: fbs
hbs: hbs
csharp: cs
cs: cs
ada: adb ads
red: red r reds
rescript: resi res
hs: hs lhs
haskell: hsc hs c2hs lhs cpphs
html: html htm ejs
graphql: graphql graphqls
nim: nimble nimf nim nims
postscript: ps eps
rust: rs
purs: purs
bitbake: bb inc bbappend conf bbclass
ebuild: ebuild eclass
minified: min.html min.js min.css
sass: sass scss
css: css scss
less: less
ats: ats dats hats sats
dts: dtsi dts
devicetree: dtsi dtso dts
msbuild: proj csproj fsproj vcxproj sln props targets
batch: bat
bat: bat
cmd: cmd bat
gradle: gradle gradle.kts = gradle-wrapper.* gradle.properties gradlew gradlew.bat
scala: scala sbt
janet: janet
thrift: thrift
swift: swift
php: php3 php4 php5 php7 php8 phtml php pht
kotlin: kts kt
racket: rkt
mint: mint
systemd: slice device service scope conf path link swap timer target socket mount automount
robot: robot
typoscript: ts typoscript
dart: dart
buildstream: bst
xml: xjb xsd dtd rng sch xhtml xml xsl xslt xml.dist
rst: rst
gap: gd g gi gap tst
zstd: zstd zst
fut: fut
txt: txt
meson: = meson.build meson.options meson_options.txt
cmake: cmake = CMakeLists.txt
cuda: cuh cu
raku: pl6 pm6 p6 rakudoc rakumod rakutest raku
ruby: rb gemspec rbw = .irbrc Gemfile Rakefile config.ru
rocq: v
coq: v
v: vsh v
sv: vg h svh v sv
verilog: vh svh v sv
csv: csv
r: R Rmd r Rnw
boxlang: bxm bxs bx
md: mkd md mkdn mdwn markdown mdown mdx
markdown: mkd md mkdn mdwn markdown mdown mdx
elixir: livemd exs ex eex heex leex
nix: nix
clojure: cljc clj cljs cljx
perl: PL plh pl perl pm t plx
asp: ascx.vb aspx.vb asp ascx.cs aspx.cs ascx aspx
java: java jsp properties jspx
fsharp: fsi fs fsx
js: vue js cjs mjs jsx
ts: ts cts mts tsx
typescript: ts cts mts tsx
cython: pxd pxi pyx
yacc: y
hy: hy
lilypond: ly ily
ocaml: mli mll ml mly
soy: soy
python: pyi py
py: pyi py
tex: bib cls ins tex dtx ltx sty
groovy: gradle groovy
gzip: gz tgz
xz: xz txz
"""


def _read(table: str) -> dict[str, list[str]]:
    found = {}
    for row in table.strip().splitlines():
        name, _, rest = row.partition(":")
        ends, _, globs = rest.partition("=")
        found[name] = [f"*.{e}" for e in ends.split()] + globs.split()
    return found


TYPES: dict[str, list[str]] = _read(_TABLE)
