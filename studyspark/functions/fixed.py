"""Fixed values. These must equal the specified ones for results to be right; nothing here is logic."""

from __future__ import annotations

# Characters str.strip() removes, and the same set as a regex class body.
SPACES = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"

# HTML entities, decoded in this order.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))

# Terms that raise the estimated academic level of a chunk.
TECHNICAL_TERMS = (
    "hypothesis", "methodology", "analysis", "synthesis", "inference",
    "algorithm", "optimization", "differential", "integral", "theorem",
    "quantum", "molecular", "kinetic", "entropy", "catalyst",
)

# Keywords that mark an academic concept.
ACADEMIC_KEYWORDS = (
    "hypothesis", "theorem", "algorithm", "principle", "theory", "method",
    "process", "system", "model", "framework", "approach", "technique",
    "analysis", "synthesis", "equation", "formula", "reaction", "mechanism",
    "structure", "function", "property", "characteristic", "behavior",
    "phenomenon", "effect", "law", "rule", "concept", "definition",
)

# Stop words for entity mentions.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "can", "this", "that",
    "these", "those", "it", "its", "they", "them", "their",
)

# Stop words for entities used in questions.
QUESTION_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were",
)

# Words near a proper noun that make it an Entity.
ENTITY_CONTEXT = ("discovered", "developed", "proposed", "named")

# A sentence with one of these explains a cause.
CAUSAL_PHRASES = ("because", "due to", "causes", "results in", "leads to")

# Line starts that introduce an example.
EXAMPLE_STARTS = ("e.g.", "example", "for instance")

# Academic levels from least to most advanced.
LEVEL_ORDER = ("primary", "middle", "high school", "undergraduate", "graduate")

# Base difficulty per estimated level; any other level counts as 2.
LEVEL_DIFFICULTY = (("basic", 1), ("intermediate", 2), ("advanced", 4))

# Question templates of the heuristic generator: (kind, text).
HEURISTIC_TEMPLATES = (
    ("definition", "What is {entity}?"),
    ("definition", "Define {entity}."),
    ("definition", "Explain the concept of {entity}."),
    ("why_how", "Why does {topic} occur?"),
    ("why_how", "How does {process} work?"),
    ("why_how", "What causes {phenomenon}?"),
    ("difference", "What is the difference between {entity1} and {entity2}?"),
    ("difference", "How do {entity1} and {entity2} differ?"),
    ("difference", "Compare {entity1} and {entity2}."),
    ("formula", "What is the formula for {concept}?"),
    ("formula", "Write the equation for {process}."),
    ("formula", "Express {relationship} mathematically."),
    ("application", "What is an example of {concept}?"),
    ("application", "How is {principle} applied?"),
    ("application", "Where is {method} used?"),
)

# Question templates of the template generator: (kind, text).
PLAIN_TEMPLATES = (
    ("definition", "What is {entity}?"),
    ("definition", "Define {entity}."),
    ("definition", "Explain what {entity} means."),
    ("definition", "What do you understand by {entity}?"),
    ("definition", "How would you define {entity}?"),
    ("why_how", "Why is {entity} important?"),
    ("why_how", "How does {entity} work?"),
    ("why_how", "Explain how {entity} functions."),
    ("why_how", "Why do {entity_plural} use {entity}?"),
    ("why_how", "What is the purpose of {entity}?"),
    ("why_how", "How is {entity} implemented?"),
    ("difference", "What is the difference between {entity1} and {entity2}?"),
    ("difference", "Compare {entity1} and {entity2}."),
    ("difference", "How does {entity1} differ from {entity2}?"),
    ("difference", "What distinguishes {entity1} from {entity2}?"),
    ("difference", "Contrast {entity1} and {entity2}."),
    ("formula", "What is the formula for {entity}?"),
    ("formula", "State the equation for {entity}."),
    ("formula", "What is the chemical formula for {entity}?"),
    ("formula", "How is {entity} calculated?"),
    ("formula", "What mathematical expression represents {entity}?"),
    ("application", "How is {entity} applied in practice?"),
    ("application", "What are the real-world applications of {entity}?"),
    ("application", "Where is {entity} used?"),
    ("application", "How can {entity} be applied to solve problems?"),
    ("application", "Give an example of {entity} in use."),
)

# Weight in percent of every processing step, in order.
STEP_WEIGHTS = (
    ("download", 5), ("ocr", 25), ("structure", 10), ("parse", 15),
    ("summarize", 15), ("graph", 15), ("flashcards", 10), ("finalize", 5),
)

# A failure of one of these fails the whole task.
CRITICAL_STEPS = ("download", "ocr", "parse")

# Price per 1000 tokens: (model family, prompt, completion) and (model family, flat).
PARSER_PRICES = (("gpt-4", 0.03, 0.06), ("other", 0.0015, 0.002))
FLAT_PRICES = (("gpt-4", 0.06), ("other", 0.002))

# Keys whose values never reach a log.
SENSITIVE_KEYS = ("password", "confirmPassword", "token", "accessToken", "refreshToken", "secret")

# OCR services in fallback order.
OCR_SERVICES = ("pixtral", "trocr", "textract")

# Patterns.
FORMULA_MARK = (
    r"[=+×÷→⇒/]"
    r"|[₀-₉₊₋₌]"
    r"|[⁰-⁹⁺⁻⁼]"
    r"|(^|[^\p{L}\p{N}_])[A-Z]O[0-9]"
    r"|\$[^\$]*\$"
    r"|\\left|\\right|\\frac|\\sqrt"
    r"|(^|[^\p{L}\p{N}_])([A-Za-z]|[0-9]+)-([A-Za-z]|[0-9]+)($|[^\p{L}\p{N}_])"
)
LIST_START = r"^([-*•]|[0-9]+\.)"
LIST_MARKER = r"^(?:[-*•][\t-\r ]+|[0-9]+[.)][\t-\r ]+|[a-zA-Z][.)][\t-\r ]+)"
TABLE_DIVIDER = r"^[\t-\r ]*\|?[\t-\r ]*:?-+([\t-\r ]*\|[\t-\r ]*:?-+)*[\t-\r ]*$"
RULED_HEADING = r"^[-_]+[\t-\r ]*[^-_].*"
MATH_PATTERNS = (r"\$\$(.+?)\$\$", r"\\\[(.+?)\\\]", r"\$(.+?)\$")
MATH_MARKUP = r"\$\$.*?\$\$|\\\[.*?\\\]|\$.*?\$"
FORMULA_SPAN = r"[A-Za-z0-9]+[\t-\r ]*[=+×÷→⇒][\t-\r ]*[A-Za-z0-9+×÷→⇒\t-\r ]+"
ANSWER_FORMULA = r"[A-Z0-9]+[\t-\r ]*[=+×÷→⇒±][\t-\r ]*[A-Za-z0-9+×÷→⇒±\t-\r ]+"
NORMAL_FORMULA = r"[=+×÷→⇒±∫∂Δ∑∏√²³⁴⁰¹⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]"
TYPE_FORMULA = r"[=+×÷→⇒±∫∂Δ∑∏√]|[₀-₉₊₋₌]|[⁰-⁹⁺⁻⁼]|[0-9]+[A-Z][A-Z0-9]*"
CHEMICAL = r"^[A-Z][a-z]?[0-9₀₁₂₃₄₅₆₇₈₉]*(?:[A-Z][a-z]?[0-9₀₁₂₃₄₅₆₇₈₉]*)*$"
TERM_FORMULA = r"[=+×÷→⇒±]"
