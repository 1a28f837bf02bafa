"""Schemas of the tables that go between operators."""

DECORATOR = "struct<name: string, is_call: boolean>"
FUNCTION = f"struct<name: string, line_number: int, arguments: array<string>, return_type: string, docstring: string, calls: array<string>, instantiates: array<string>, decorators: array<{DECORATOR}>>"
CLASS = f"struct<name: string, line_number: int, inherits_from: array<string>, docstring: string, methods: array<{FUNCTION}>, decorators: array<{DECORATOR}>>"

#: One row a file. ``parse_error`` is null where the file could be read.
PARSED = f"file_path string, imports array<string>, classes array<{CLASS}>, functions array<{FUNCTION}>, parse_error string"
#: One row a piece of a file, in file order. ``continued``: the only class has its head in an earlier piece. ``failed``: the piece is no sequence of statements.
PIECES = f"{PARSED}, piece int, continued boolean, failed boolean"
FILES = "path string, rel_path string, name string, size long, mtime double, depth int, is_dir boolean"
SOURCES = "rel_path string, content binary"
NODES = "id string, type string, label string, file_path string, line_number int, docstring string, module_origin string"
EDGES = "source string, target string, relationship string, decorator_name string"
QUESTIONS = "question_id long, question string"
CANDIDATES = (
    "id string, question string, expected_symbol string, repository string, category string, quality_score double, "
    "generation_reason string, template_family string, review_status string, review_notes string, benchmark_version string"
)
NODE_TYPES = ("Class", "File", "Function", "Method", "Module")
CODE_TYPES = ("Class", "Function", "Method")
