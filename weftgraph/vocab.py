"""Dimension tables of the ranker and the graph builder, as plain text.

Fixed values: results depend on them, so that they are the published ones, in
their natural order.  They are small and never grow with the data.
"""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text.split()))


def _table(text: str) -> dict[str, tuple[str, ...]]:
    """Lines of ``key: words``; a key that comes again replaces the one before."""
    return {k.strip(): _words(v) for k, v in (line.split(":", 1) for line in text.strip().splitlines())}


# Words that are never keywords.
STOP_WORDS = _words("""
    a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought how what when where
    which who whom why this that these those it its i you he she we they me him her us them in on at by for with about against between into through
    during before after to from up down out of off over under again then once and but or nor so yet both either neither not no nor only own same than
    too very just because as until while though although get gets got getting work works working make makes made use used using done does way ways
""")

# Suffixes in the order they are tried; three characters must stay.
STEM_SUFFIXES = _words("pping ning ing ation ations tion tions ed er ers es s")

# Words that show an intent, intents in order of declaration.
INTENT_WORDS = _table("""
parsing: parse pars parsing parsed parser parsers read decode deserialise deserialize interpret tokenize tokenise lex lexer extract scan walk traverse
generation: generate generat generation construct produce render emit output synthesize format serialise serialize encode write compile
retrieval: retriev retrieve retrieval search find lookup look fetch query filter select resolve index scan getter getsource getnode
loading: load import read open ingest stream fetch download pull
saving: save write store persist export dump upload push commit flush
visualization: visualize visualis plot chart graph draw render display show diagram view
statistics: statistic stats metric analytics analytic count measure aggregate histogram distribution summary report degree hotspot
analysis: analys analyze analyse inspect detect identify profile audit check scan evaluate assess dependency dependencies impact blast radius
authentication: auth authenticat login signin logout signout token permission authoriz authoris credential session oauth jwt
routing: route router endpoint url path dispatch handler middleware request register registr mount include add_route
validation: validat validate check verify sanitiz sanitise schema constraint rule enforce
execution: run execut invoke call trigger dispatch start launch schedule task
configuration: config configur setting option parameter env environment setup init initializ
transformation: transform convert map translate normalize normalise clean process pipeline enrich
graph_traversal: subgraph traverse traversal walk visit hop neighbour neighbor adjacent reachable path chain ancestry ancestor descendant connected extract expand explore bfs dfs breadth depth spanning topology topological inherit inheritance hierarchy subclass parent
aggregation: aggregat aggregate count rank ranking ranked compute calculat calculate sum total average mean median top bottom most least distribution frequency histogram percentile hotspot hotspots degree centrality
""")

# Intents that ask for an implementation.
IMPLEMENTATION_INTENTS = _words("""
    parsing generation retrieval loading saving analysis authentication routing execution transformation graph_traversal
""")

# Verbs in labels that go with an intent.
INTENT_VERBS = _table("""
retrieval: fetch retrieve retriev find search lookup resolve query filter select get
parsing: parse pars read decode extract lex tokenize tokenise scan load
generation: generate generat construct produce render emit format compile serialize serialise encode
graph_traversal: traverse walk visit explore expand extract subgraph hop reach bfs dfs
statistics: compute calculat calculate aggregate count rank measure summarize summarise
aggregation: compute calculat calculate aggregate count rank sum total average
analysis: analyze analyse inspect detect identify evaluate assess profile
transformation: transform convert map translate normalize normalise clean process
loading: load import ingest stream fetch download
saving: save store persist export dump write
execution: run execut invoke trigger dispatch launch send perform call execute
routing: route register registr mount include handle dispatch redirect forward
authentication: auth authenticat login logout verify validate token session
validation: validat validate verify check sanitiz enforce constrain
""")

# Phrase | intents | forms in labels and ids.
PHRASES = tuple(tuple(p.strip() for p in line.split("|")) for line in """
call graph | graph_traversal analysis | call_graph, callgraph, call graph
import graph | graph_traversal analysis | import_graph, importgraph
dependency graph | graph_traversal analysis | dependency_graph, dependencygraph, dep_graph
inheritance tree | graph_traversal analysis | inheritance_tree, inheritancetree, class_hierarchy
subgraph | graph_traversal | subgraph, sub_graph
subgraph extracted | graph_traversal retrieval | extract_subgraph, subgraph_extract, get_subgraph, build_subgraph, subgraph
import chain | graph_traversal analysis | import_chain, importchain, dependency_chain
call chain | graph_traversal analysis | call_chain, callchain, invocation_chain
blast radius | analysis graph_traversal | blast_radius, blastradius, impact_radius
impact analysis | analysis | impact_analysis, impactanalysis, change_impact
node degree | aggregation statistics | node_degree, nodedegree, degree
most connected | aggregation statistics | most_connected, top_connected, hotspot
architectural hotspot | aggregation statistics | architectural_hotspot, hotspot, architectural_hotspots
graph statistics | statistics aggregation | graph_statistics, graphstatistics, graph_stats, compute_statistics, calculate_statistics
top files | aggregation statistics | top_files, files_by_degree, ranked_files
node context | retrieval graph_traversal | get_node_context, node_context, fetch_context
callable context | retrieval | get_callable_context, callable_context
class context | retrieval | get_class_context, class_context
llm context | retrieval generation | build_llm_context, llm_context, llm_prompt
graph generated | generation graph_traversal | generate_graph, construct_graph, create_graph, make_graph, build_graph
graph built | generation graph_traversal | build_graph, construct_graph, create_graph, graph_builder, graph_build
graph nodes | graph_traversal generation | add_node, create_node, insert_node, build_graph, construct_graph, graph_node, node_create, node_add
graph edges | graph_traversal generation | add_edge, create_edge, insert_edge, build_graph, construct_graph, graph_edge, edge_create, edge_add
inheritance represented | graph_traversal analysis | inherits, inheritance, inherit, class_hierarchy, build_class_graph, class_graph, hierarchy_graph, inheritance_tree
inheritance | graph_traversal analysis | inherits, inheritance, inherit, class_hierarchy, hierarchy, build_class_graph, class_graph
hotspots calculated | aggregation statistics | generate_statistics, compute_statistics, calculate_statistics, calculate_hotspots, compute_hotspots, hotspot_analysis
hotspots computed | aggregation statistics | generate_statistics, compute_statistics, calculate_statistics, hotspot_analysis
context built | generation retrieval | build_context, context_builder, build_llm_context, context_build, create_context, make_context
context build | generation retrieval | build_context, context_builder, build_llm_context, create_context, make_context
""".strip().splitlines())

# Keyword: synonyms.
SYNONYMS = _table("""
parse: read load decode deserialise deserialize extract scan lex tokenize
pars: read load extract
read: parse load open ingest
load: read parse open fetch import
decode: parse deserialise deserialize
build: create construct generate make produce
generate: construct create produce emit
generat: construct create
create: construct build make produce add
creat: construct build make add instantiate
construct: build create instantiate
retrieve: search fetch find lookup query
retriev: search fetch find lookup
retrieval: retrieve search fetch find
search: find retrieve lookup filter query
find: search retrieve lookup query
fetch: retrieve load download
lookup: find search retrieve resolve
query: search find retrieve filter
resolve: lookup find fetch retrieve
save: store write persist export dump
saved: save store persist write
sav: save store persist
store: save persist write cache
persist: save store write
write: save store output emit
export: write save dump output
walk: traverse visit iterate scan explore
traverse: walk visit iterate explore subgraph
traversal: traverse walk visit explore
visit: walk traverse iterate
iterate: walk traverse loop enumerate
explore: traverse walk visit expand
expand: explore traverse extend grow
subgraph: traverse extract subgraph walk graph
hop: traverse walk step neighbour
neighbour: adjacent connected hop neighbor
neighbor: adjacent connected hop neighbour
graph: network topology structure
node: vertex element symbol
edge: link connection relationship arc
degree: centrality connectivity hotspot rank
hotspot: degree hub central connected statistic
hotspots: degree hub statistic statistics
dependency: import require depend
chain: path sequence pipeline
inheritance: inherits inherit hierarchy parent subclass class_graph class_hierarchy
inherit: inheritance extends subclass parent class_graph
inherits: inheritance extends subclass class_graph
represent: model encode capture store express
context: build prompt llm package
llm: context prompt language model
analyse: analyze inspect evaluate examine
analyze: analyse inspect evaluate examine
inspect: analyse analyze examine check
evaluate: analyse analyze assess check
impact: blast radius effect change
transform: convert map translate process normalize
convert: transform map translate cast
normalise: normalize transform clean standardise
normalize: normalise transform clean standardize
render: display draw show visualize emit
visualize: render display draw plot chart
display: render show visualize draw
plot: visualize chart render draw
validate: verify check sanitize enforce constrain
validat: verify check sanitize
verify: validate check ensure confirm
statistics: metrics analytics stats summary report
statistic: metric analytic stat
metrics: statistics analytics stats measurements
analytics: statistics metrics analysis reporting
aggregate: count sum compute calculate rank
aggregat: count sum compute rank
compute: calculate aggregate rank measure
calculat: compute aggregate measure
rank: sort order top degree hotspot
count: aggregate tally measure total
repository: repo codebase project package
repo: repository codebase project
file: module source script
module: file package component
class: type model schema entity
function: method callable procedure routine
method: function callable procedure
callable: function method routine
extract: retrieve fetch get pull subgraph
response: reply output return
responses: reply output return
respons: reply output
route: endpoint path url handler
routes: route endpoints paths handlers
rout: route endpoint path handler
middleware: interceptor filter hook
request: http query call send
requests: http query send
http: request send connection transport
session: connection client pool send
adapter: transport connector client send
redirect: forward location status
register: add mount attach include
registered: added mounted attached
registr: add mount attach
execut: run invoke send call perform dispatch
execute: run invoke send call perform
manag: handle control maintain create
manage: handle control maintain create
handl: process execute run dispatch
handle: process execute run dispatch
command: cmd subcommand cli
argument: arg param option flag
arguments: args params options flags
argument: arg param option
callback: handler hook action
option: flag param argument
options: flags params arguments
""")

# Class names that look like plain data.
DATA_NAME = "|".join("""
^parsed
^generated
^fetched
^loaded
^saved
^processed
^serialized
^raw
^dto
(schema|dto|record)$
(request|response|reply|payload|body)$
(result|output|summary|report)$
(entity|document|row|item|entry)$
(config|settings|options|params|args)$
(event|message|packet|frame|envelope)$
(type|types|kind|enum)$
(degree|metric|stat|stats|counter)$
""".split())

# Fragments of decorators and parents of plain data.
DATA_DECORATORS = _words("""
    dataclass basemodel model schema dataclasses attr attrs frozen namedtuple
""")

# Fragments of labels that are never plain data.
GRAPH_LABELS = _words("""
    graphnode graphedge repositorygraph graph_node graph_edge repository_graph graphbuilder graph_builder nodetype node_type edgetype edge_type
    relationshiptype relationship_type
""")

# Names that are never symbols of a repository.
BUILTIN_SYMBOLS = _words("""
    bool bytearray bytes complex dict float frozenset int list memoryview object range set slice str tuple type ArithmeticError AssertionError
    AttributeError BaseException BlockingIOError BrokenPipeError BufferError BytesWarning ChildProcessError ConnectionAbortedError ConnectionError
    ConnectionRefusedError ConnectionResetError DeprecationWarning EOFError EnvironmentError Exception FileExistsError FileNotFoundError
    FloatingPointError FutureWarning GeneratorExit IOError ImportError ImportWarning IndentationError IndexError InterruptedError IsADirectoryError
    KeyError KeyboardInterrupt LookupError MemoryError ModuleNotFoundError NameError NotADirectoryError NotImplementedError OSError OverflowError
    PendingDeprecationWarning PermissionError ProcessLookupError RecursionError ReferenceError ResourceWarning RuntimeError RuntimeWarning
    StopAsyncIteration StopIteration SyntaxError SyntaxWarning SystemError SystemExit TimeoutError TypeError UnboundLocalError UnicodeDecodeError
    UnicodeEncodeError UnicodeError UnicodeTranslateError UnicodeWarning UserWarning ValueError Warning ZeroDivisionError classmethod staticmethod
    property super enumerate filter map reversed sorted zip open print len repr hash id iter next abs all any bin callable chr compile delattr dir
    divmod eval exec format getattr globals hasattr hex input isinstance issubclass locals max min oct ord pow round setattr sum vars
""")

# Framework names that are never symbols of a repository.
FRAMEWORK_SYMBOLS = _words("""
    BaseModel BaseSettings validator root_validator field_validator model_validator TypedDict Protocol ABC ABCMeta Generic Enum IntEnum StrEnum Flag
    IntFlag dataclass Model View APIView ModelViewSet ViewSet ModelSerializer Serializer Resource Base DeclarativeBase DeclarativeMeta Task TestCase
""")

# Calls that are not recorded.
BUILTIN_CALLS = _words("""
    len list dict set tuple sorted print str int float bool range enumerate open min max sum any all zip map filter isinstance issubclass getattr
    setattr hasattr type id repr hash iter next reversed abs round pow divmod hex oct bin callable vars dir super object
""")

# Directories without sources to parse.
SKIPPED_SOURCE_DIRS = _words("""
    .git __pycache__ .venv venv env node_modules dist build docs docs_src examples example tests test .github .idea .vscode .mypy_cache .pytest_cache
    .ruff_cache
""")

# Category: fragments, in order of declaration.
CATEGORY_WORDS = _table("""
Parsing: parse parser extract ast lexer token
Graph Construction: graph builder node edge relationship link construct build
Retrieval: retrieve retriever fetch collect query find search
Context Building: context builder prompt llm package
Routing: route router register endpoint dispatch
Authentication: auth login authenticate session token sign
Configuration: config settings setup env
HTTP: http request response client server middleware
CLI: cli command parser args argparse typer click
Visualization: visualize visualization plot render draw png
Utilities: util utils helper common format clean
""")

# Words that say nothing in a generated question.
QUESTION_STOP_WORDS = _words("""
    how what why when where which who whom is are was were be been being have has had do does did a an the and but or in on at by for with about to
    from of process implementation implemented work generic handler helper class function method
""")
# Verbs that start a symbol's name.
SYMBOL_VERBS = _words("""
    parse extract build construct generate create resolve get retrieve fetch collect register add calculate compute analyze scan clone validate check format render visualize run
""")

# Names too general to ask about.
GENERIC_NAMES = _words("helper helpers util utils wrapper wrappers temp tmp dummy mock test tests deprecated experimental")

# Extension: language.
LANGUAGES = _table("""
.py: Python
.java: Java
.js: JavaScript
.ts: TypeScript
.cpp: C++
.c: C
.cs: C#
.go: Go
.rs: Rust
.kt: Kotlin
.swift: Swift
.php: PHP
.rb: Ruby
.scala: Scala
.dart: Dart
.html: HTML
.css: CSS
.sh: Shell
.yaml: YAML
.yml: YAML
.json: JSON
.xml: XML
.md: Markdown
.toml: TOML
""")

# Category: extensions, in the order they are tried.
FILE_CATEGORIES = _table("""
source_code: .py .java .js .ts .cpp .c .cs .go .rs .kt .swift .php .rb .scala .dart
documentation: .md
configuration: .yaml .yml .json .toml .xml
assets: .png .jpg .jpeg .svg .gif .webp
""")

# Directories that are no part of a repository.
EXCLUDED_DIRS = _words(".git .github __pycache__ .venv node_modules .idea .vscode")

# Words of a question that ask for a file.
FILE_WORDS = _words("file files module modules path paths folder directory")

# Intents under which files and modules are pushed down.
NOT_FILE_INTENTS = _words("parsing generation retrieval execution authentication routing validation transformation graph_traversal statistics aggregation analysis unknown")

# Parts of labels that draw.
DRAWING_WORDS = _words("visualize visualis plot chart draw diagram visualizer visualiser")

# Hops by relationship for each intent.
RELATIONSHIPS = _words("calls inherits imports instantiates decorates overrides contains")
HOPS = {
    name.strip(): tuple(map(int, hops.split()))
    for name, hops in (
        line.split(":")
        for line in """
default: 1 1 1 1 1 1 0
routing: 2 1 1 1 2 1 0
execution: 2 1 1 2 1 1 0
analysis: 1 2 1 1 1 2 0
graph_traversal: 1 2 1 1 0 2 0
parsing: 2 1 1 1 0 1 1
loading: 1 1 2 1 0 0 0
generation: 1 1 1 1 1 0 0
retrieval: 1 1 1 1 0 1 0
authentication: 1 1 1 1 1 0 0
validation: 1 1 1 0 1 0 0
configuration: 0 1 1 0 0 0 1
statistics: 1 1 1 0 0 0 0
aggregation: 1 1 1 0 0 0 0
transformation: 2 1 1 1 0 0 0
saving: 1 1 1 1 0 0 0
""".strip().splitlines()
    )
}
