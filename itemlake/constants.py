"""Fixed values.

Every list, table, pattern and message format in this module has to hold exactly these
values for results to be right; nothing here is derived. Patterns are in Java syntax:
``(?U)`` makes ``\\s \\w \\b`` follow Unicode.
"""

# --- Option labels and answers -------------------------------------------------
OPTION_LABELS = ["A", "B", "C", "D"]
LABEL_TO_LETTER = {
    "1": "A", "2": "B", "3": "C", "4": "D",
    "a": "A", "b": "B", "c": "C", "d": "D",
    "A": "A", "B": "B", "C": "C", "D": "D",
}
NUMBER_TO_LETTER = {"1": "A", "2": "B", "3": "C", "4": "D"}
DRAFT_LABELS = ["A", "B", "C", "D", "E"]

# --- Block text patterns ---------------------------------------------------------
QUESTION_START = r"(?U)^\s*(\d{1,3})\.\s+"
OPTION_MARKER = r"(?U)\(\s*([1-4A-Da-d])\s*\)"
ANSWER_LINE = r"(?iU)Ans\.?\s*\(\s*([1-4A-Da-d])\s*\)"
ANSWER_ONLY = r"(?iU)^Ans\.?\s*\(\s*[1-4A-Da-d]\s*\)$"
INLINE_ANSWER_HINT = r"(?U)\bAns\b\.?\s*[\(\[]"
Q_PREFIX = r"(?U)^\s*[Qq]\.?\s*(\d{1,3})\s*[\.\)]\s*"
PLAIN_NUMBER_START = r"(?U)^\s*(\d{1,3})\s*[\.\)]\s+\S"
PLAIN_NUMBER_PREFIX = r"(?U)^\s*\d{1,3}\s*[\.\)]\s*"
KEY_ENTRY = r"(?U)\b(\d{1,3})\s*\.\s*\(\s*([^)]{1,8})\s*\)"
LOOSE_KEY_ENTRY = r"(?U)(\d{1,3})\s*[.)]\s*[(\[]?\s*([^)\]\s]+)\s*[)\]]?"
LONG_NUMBERED_LINE = r"(?U)^\d{1,3}\.\s+\S{10,}"
TWO_OPTIONS_LINE = r"\(1\).*\(2\)"
FULL_PAPER_SECTION = r"(?iU)\bSECTION[\s\-]+([A-Za-z])\b"
INLINE_SECTION = r"(?iU)SECTION[-\s]*([A-B])"
MERGED_MARKER = r"(?sU)^\s*\((13|24)\)\s*(.*)"
EMBEDDED_ARRAY = r"(?U)^\(\s*\$\s*\\begin"
LATEX_ARRAY = r"(?s)\\begin\{array\}.*?\\end\{array\}"
ARRAY_BEGIN = r"(?U)\\begin\s*\{\s*array\s*\}\s*(?:\{[^}]*\})?\s*"
ARRAY_END = r"(?U)\\end\s*\{\s*array\s*\}"
ARRAY_CELL_BREAK = r"\\\\|&"
CELL_OPTION = (
    r"(?sU)\{\s*\{\s*(?:\\left\s*)?\(?\s*([1-4])\s*(?:\\right\s*)?\)\s*(.*?)\s*\}\s*\}"
)
KEY_HEADER = r"answer key|ans key|ans\. key|answers|answer sheet|solution key"
HTML_TAG = r"<[^>]+>"

# --- Noise, adverts, banners -----------------------------------------------------
AD_KEYWORDS = [
    "JOIN LEADER COURSE", "ALLEN Scholarship", "ASAT", "SHOP NOW",
    "DON'T PREPARE HARDER", "Leader Online Course", "Leader Self-Study",
    "ALLEN Thank You", "Join the journey", "scholarshipwth", "MAINPYQ",
]
BANNER_TEXTS = [
    "TEST PAPER WITH ANSWER KEY",
    "TIME : 9:00 AM  TO  12:00 NOON",
    "TIME: 9:00 AM TO 12:00 NOON",
]
WATERMARKS = [r"(?iU)mathon\s*go", r"(?iU)^m\s*a\s*t\s*h\s*o"]
INLINE_WATERMARK = r"(?iU)\bmathon\s*go\b"
PAGE_HEADERS = [
    r"(?iU)\d{4}\s*\(\s*\d{1,2}\s*\w+\s*Shift\s*\d+\s*\)",
    r"(?iU)JEE\s+Main\s+(Previous|January|April|June|July|August|2\d{3})",
    r"(?iU)Previous\s+Year\s+Paper",
    r"(?iU)NEET\s+\d{4}",
    r"(?iU)^TEST\s+PAPER\b",
    r"(?iU)^TIME\s*:",
    r"(?iU)JEE\s+(MAIN|ADVANCED)\s+EXAMINA",
    r"(?iU)HELD\s+ON\s+\w+day",
    r"(?iU)^JEE\s+Main\s+\d{4}\s+\w+$",
]
MIN_TEXT_LENGTH = 4
SHORT_HEADER_LENGTH = 100
SECTION_LABEL_LENGTH = 40
GARBLED_RATIO = 0.40

# --- Subject headers of inline papers, in order of precedence ----------------------
HEADER_SUBJECTS = [
    ("PHYSICS", "physics"), ("CHEMISTRY", "chemistry"), ("MATHEMATICS", "maths"),
    ("MATHS", "maths"), ("MATH", "maths"), ("BIOLOGY", "biology"),
]

# --- Layout detection thresholds ----------------------------------------------------
INLINE_WINDOW = 5
INLINE_SHARE = 0.6
SEPARATE_KEY_HEAD = 0.7
SEPARATE_KEY_MAX_INLINE = 3
FULL_PAPER_HEAD_BLOCKS = 50
FULL_PAPER_TAIL = 0.75
DENSE_KEY_TAIL = 0.85
DENSE_KEY_ENTRIES = 3
IMAGE_KEY_TAIL = 5
KEY_VALUE_LENGTH = 6

LAYOUTS = ["inline_answer", "separate_answer_key", "with_solution", "full_paper"]

# --- Block type synonyms ---------------------------------------------------------------
BLOCK_TYPES = {
    "text": ["text", "plain_text"],
    "image": ["image", "figure", "chart"],
    "table": ["table"],
    "equation": ["equation", "formula", "inline_equation", "interline_equation"],
}

# --- Exams, subjects, chapters -----------------------------------------------------------
EXAM_ALIASES = {
    "jee main": "JEE Main", "jee mains": "JEE Main", "jee-main": "JEE Main",
    "jee-mains": "JEE Main", "jeemain": "JEE Main", "jeemains": "JEE Main",
    "jee": "JEE Main", "jee 2024": "JEE Main", "jee main 2024": "JEE Main",
    "iit jee": "JEE Main",
    "jee advanced": "JEE Advanced", "jee adv": "JEE Advanced",
    "jee-advanced": "JEE Advanced", "iit jee advanced": "JEE Advanced",
    "advanced": "JEE Advanced",
    "neet": "NEET", "neet ug": "NEET", "neet-ug": "NEET", "neet 2024": "NEET",
    "cuet": "CUET", "cuet ug": "CUET", "cuet 2024": "CUET",
}
SUBJECT_ALIASES = {
    "physics": "physics", "phy": "physics", "ph": "physics",
    "chemistry": "chemistry", "chem": "chemistry", "ch": "chemistry",
    "mathematics": "mathematics", "maths": "mathematics", "math": "mathematics",
    "maths.": "mathematics",
    "biology": "biology", "bio": "biology",
    "english": "english", "eng": "english",
    "hindi": "hindi",
}
SUBJECT_MARKERS = [
    ("phy", "physics"), ("chem", "chemistry"), ("math", "mathematics"), ("bio", "biology"),
]
ALL_SUBJECTS = ["physics", "chemistry", "mathematics", "biology", "english", "hindi"]
EXAM_SUBJECTS = {
    "JEE Main": ["physics", "chemistry", "mathematics"],
    "JEE Advanced": ["physics", "chemistry", "mathematics"],
    "NEET": ["physics", "chemistry", "biology"],
    "CUET": ["physics", "chemistry", "mathematics", "biology", "english", "hindi"],
}
CHAPTER_ALIASES = {
    "Newton's Laws of Motion": "Laws of Motion",
    "Newton Laws": "Laws of Motion",
    "Newton's Laws": "Laws of Motion",
    "Rotational Mechanics": "Rotational Motion",
    "Rotational Dynamics": "Rotational Motion",
    "Simple Harmonic Motion": "Oscillations",
    "SHM": "Oscillations",
    "Wave Optics": "Wave Optics",
    "Ray Optics": "Ray Optics and Optical Instruments",
    "Electrostatics": "Electric Charges and Fields",
    "Gravitation": "Gravitation",
    "Work Energy Theorem": "Work, Energy and Power",
    "Work-Energy": "Work, Energy and Power",
    "Organic Chemistry": "Some Basic Principles of Organic Chemistry",
    "Chemical Equilibrium": "Equilibrium",
    "Ionic Equilibrium": "Equilibrium",
}

# --- Formula markers and bare LaTeX commands ------------------------------------------------
FORMULA_MARKERS = ["$", "\\frac", "\\sqrt", "\\int", "\\sum"]
BARE_LATEX = (
    r"(\\(?:text|frac|dfrac|mathrm|mathbf|mathit|sqrt|times|div|cdot|pm|mp"
    r"|alpha|beta|gamma|delta|theta|phi|psi|omega|lambda|mu|nu|rho"
    r"|sigma|tau|pi|epsilon|zeta|eta|kappa|xi|chi"
    r"|Delta|Gamma|Sigma|Omega|Lambda|Pi|Theta|Phi|Psi"
    r"|nabla|infty|partial|hbar"
    r"|int|oint|sum|prod|lim|log|ln|sin|cos|tan|cot|sec|csc"
    r"|vec|hat|bar|dot|ddot|tilde|overline|underline"
    r"|rightarrow|leftarrow|Rightarrow|Leftarrow|leftrightarrow"
    r"|le|ge|neq|approx|equiv|propto|sim|simeq|cong"
    r"|circ|bullet|star|dagger|perp|parallel"
    r"|left|right|big|Big|bigg|Bigg)"
    r"(?:\{[^}]*\})*(?:[\^_]\{[^}]*\})*(?:[\^_][0-9])*)"
)

# --- JSON responses ---------------------------------------------------------------------------
JSON_FENCE = r"(?sU)```(?:json)?\s*(\{.*?\})\s*```"
JSON_BRACES = r"(?s)\{.*\}"
JSON_BAD_ESCAPE = (
    r"\G((?:[^\\]|\\[\"\\/]|\\u[0-9a-fA-F]{4}|\\[bfnrt](?!\p{L}))*+)\\([^\n])"
)
EMPTY_WORDS = ["null", "none", ""]
TRUE_WORDS = ["true", "1", "yes"]

# --- Requests ------------------------------------------------------------------------------------
DIFFICULTIES = ["easy", "medium", "hard"]
SECTION_TYPES = ["mcq", "integer"]
CHAPTER_MODES = ["exact", "upto", "from", "between", "after", "all"]
MODE_FIELD = {
    "exact": "chapter", "upto": "chapter_upto", "from": "chapter_from",
    "after": "chapter_after", "between": "chapter_from",
}
MIN_QUESTIONS = 1
MAX_QUESTIONS = 200
FUZZY_SCORE = 85
SUGGESTIONS = 8
MISSING_ORDER = 9999
PREVIEW_LENGTH = 120
PREVIEW_SAMPLE = 5
ALTERNATIVES = 3
DEFAULT_SPLIT = [("easy", 0.2), ("medium", 0.5), ("hard", 0.3)]

# --- States -----------------------------------------------------------------------------------------
QUESTION_STATUSES = ["active", "archived", "flagged"]
STAGES = ["UPLOADED", "MINERU_COMPLETE", "QUESTIONS_BUILT", "METADATA_COMPLETE", "SAVED"]
FAILED = "FAILED"
ERROR_LENGTH = 2000
#: Rows of a list page at most.
PAGE_LIMIT = 500
PATCH_FIELDS = [
    "exam_name", "subject", "chapter", "topic", "subtopic", "difficulty",
    "question_type", "concepts", "has_diagram", "has_formula",
]
REVIEW_FIELDS = [
    ("Exam", "exam_name"), ("Subject", "subject"), ("Chapter", "chapter"),
    ("Topic", "topic"), ("Subtopic", "subtopic"), ("Difficulty", "difficulty"),
    ("Type", "question_type"),
]
