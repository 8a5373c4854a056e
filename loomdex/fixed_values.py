"""Lists, patterns, thresholds and formats that decide results.

They are data, not logic: changing one changes what the jobs compute.
"""

# --- whitespace -------------------------------------------------------------
# Characters that count as white space when text is trimmed.
WHITESPACE = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as a regular-expression class, with and without the line feed.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_IN_LINE = r"[\t\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# --- markup cleaning ----------------------------------------------------------
# Directives that are removed together with their indented body, in this order.
BLOCK_DIRECTIVES = (
    "meta", "facet", "contents", "dismissible-skills-card", "cta-banner",
    "composable-tutorial", "selected-content", "literalinclude", "include",
    "image", "figure", "seealso", "tabbed", "tab", "toctree",
)
# Directives removed as a single line.
LINE_DIRECTIVES = ("default-domain",)

# Patterns of the cleaning rules ({ws} stands for the white-space class).
# The block body is possessive: a backtracking loop over thousands of lines
# overflows the stack of the Java regex engine.
BLOCK_BODY = r"(?:[ \t]+[^\n]*+\n|\n)*+"
BLOCK_DIRECTIVE = r"(?m)^\.\.{ws}+{name}::[^\n]*\n" + BLOCK_BODY
LINE_DIRECTIVE = r"(?m)^\.\.{ws}+{name}::[^\n]*\n"
INCLUDE_LINE = r"(?m)^[ \t]*\.\.{ws}+include::[^\n]*\n"
LABEL_ANCHOR = r"(?m)^\.\.{ws}+_[a-zA-Z0-9_-]+:{ws}*\n"
CODE_BLOCK_LINE = r"(?m)^\.\.{ws}+code-block::[^\n]*\n"
ROLE_WITH_TARGET = r":[a-zA-Z][a-zA-Z0-9_-]*:`([^`<>]+){ws}+<[^`>]+>`"
ROLE = r":[a-zA-Z][a-zA-Z0-9_-]*:`([^`]+)`"
INLINE_CODE = r"``([^`]+)``"
PIPE_SUBSTITUTION = r"\|[a-zA-Z][a-zA-Z0-9_-]*\|"
# The white-space class is nested in the class of letters: a repeated group would recurse.
BRACE_SUBSTITUTION = r"\{\+[a-zA-Z][a-zA-Z0-9_+\-{ws}]*\+\}"
ANY_BLOCK_DIRECTIVE = r"(?m)^\.\.{ws}+[a-zA-Z][a-zA-Z0-9_-]*::[^\n]*\n" + BLOCK_BODY
INDENTED_DIRECTIVE_LINE = r"(?m)^[ \t]+\.\.{ws}+[a-zA-Z][a-zA-Z0-9_-]*::[^\n]*\n"
BULLET_INCLUDE = r"(?m)^[ \t]*[-*]{ws}+\.\.{ws}+include::[^\n]*\n"
COMMENT_LINE = r"(?m)^[ \t]*\.\.{ws}+(?![_a-zA-Z][a-zA-Z0-9_-]*::)[^\n]*\n"
DEEP_INDENT = r"(?md)^{ws_in_line}{3,}"
BLANK_RUN = r"\n{3,}"
# A title decoration line: one of these characters, three times or more.
DECORATION = r"^([=\-~^.`'\"#*+_])\1{2,}{ws}*$"

# --- corpus and chunk limits ---------------------------------------------------
SHORT_SOURCE_CHARS = 100      # a raw file below this is flagged as suspiciously short
SHORT_DOCUMENT_CHARS = 500    # a cleaned document below this is flagged as short
MIN_CORPUS_DOCUMENTS = 20     # a usable corpus has at least this many documents
PREVIEW_CHARS = 400
CHUNK_SIZE, CHUNK_OVERLAP = 800, 100
CHUNK_INDEX_DIGITS = 4
CHARS_PER_TOKEN = 4
OVERLAP_PROBE_CHARS = 30      # overlap check: this much of the carried tail ...
OVERLAP_PROBE_SLACK = 50      # ... must be found in the first overlap + slack chars

# --- embedding, retrieval, answers -----------------------------------------------
EMBED_BATCH = 50
TOP_K = 5
CANDIDATE_FACTOR = 10
EMBEDDING_DIMENSION = 3072
CONTEXT_ITEM = "[{rank}] Source: {title}\n{text}"
CONTEXT_SEPARATOR = "\n\n---\n\n"
CONTEXT_HEADING = "--- Documentation Context ---"
QUESTION_HEADING = "--- Question ---"
INSUFFICIENT_PHRASE = "does not provide enough information"
TRANSIENT_CODES = ("429", "500", "502", "503", "504")
QUOTA_CODE, QUOTA_WORD = "429", "quota"
ERROR_CODE = r'"code":(\d+)'
ERROR_MESSAGE_CHARS = 200
MISS_QUESTION_CHARS = 50

# --- answer scoring -----------------------------------------------------------------
HIT_CUTOFFS = (1, 3, 5)
CORRECT_FROM = 0.65
PARTIAL_FROM = 0.40
ANSWER_LABELS = ("correct", "partially_correct", "incorrect", "needs_manual_review")
# Java's \b is Unicode-aware, so the ASCII word boundary is spelled out.
KEYWORD = r"(?<![0-9a-z_])([a-z]{5,})(?![0-9a-z_])"
STOP_WORDS = (
    "about", "above", "after", "again", "against", "allow", "also", "although",
    "always", "another", "based", "because", "before", "being", "between",
    "could", "during", "either", "every", "following", "given", "however",
    "include", "including", "instead", "least", "means", "might", "more",
    "most", "must", "other", "over", "same", "should", "since",
    "some", "such", "than", "that", "their", "there", "these", "they",
    "this", "those", "through", "under", "until", "using", "when", "where",
    "which", "while", "with", "within", "without", "would", "your",
)
