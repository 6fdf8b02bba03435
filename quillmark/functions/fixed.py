"""Fixed values that results depend on: word lists, patterns, constants. Larger tables (taxonomies, topic names) are input tables, not constants."""

# --- fixed values: sections, quotas, marks ---
SECTION_QUOTAS = {"verbal_ability": 30, "general_awareness": 25, "reasoning": 25, "numerical_ability": 20}
MARKS_RIGHT, MARKS_WRONG = 3, 1
ZONES = [("verbal_ability", 1, 30), ("general_awareness", 31, 55), ("reasoning", 56, 80), ("numerical_ability", 81, 100)]

# --- fixed values: quality score ---
DIRECTIVE_CUES = [
    r"choose\s+the\s+correct", r"select\s+the\s+(?:correct|right|best)", r"find\s+(?:the|out)", r"which\s+(?:of|one)", r"what\s+(?:is|are|was|were)",
    r"who\s+(?:is|are|was|were)", r"where\s+(?:is|are|was|were)", r"when\s+(?:is|was|did)", r"how\s+(?:many|much|is|are)", r"identify\s+the",
    r"solve\s+(?:the|for)", r"calculate", r"simplify", r"answer\s+figure", r"read\s+the\s+passage",
]
OPTION_MARK = r"\([abcd]\)|(?:^|[^\p{L}\p{N}_])[abcd]\s*[.:)]"
PLACEHOLDER_MARKERS = [
    "placeholder", "question not available", "text not extracted", "ocr failed", "[verbal", "[ga", "[reasoning", "[math", "trailing placeholder", "inferred",
]

# --- fixed values: question types ---
TYPE_PATTERNS = {
    "calculation": [r"\d+\s*[+\-×÷*/]\s*\d+", r"find\s+the\s+value", r"calculate", r"what\s+is\s+the\s+(?:sum|difference|product|ratio)", r"how\s+(?:much|many)", r"solve"],
    "conceptual": [r"what\s+is\s+(?:the\s+)?(?:meaning|definition)", r"explain", r"why\s+(?:is|does|do)", r"difference\s+between"],
    "factual": [r"who\s+(?:is|was|are|were)", r"when\s+(?:was|did|is)", r"where\s+(?:is|was)", r"which\s+(?:is|was)", r"capital\s+of", r"headquarters"],
    "application": [r"if\s+.+\s+then", r"in\s+the\s+given\s+(?:figure|diagram)", r"according\s+to\s+the\s+passage", r"apply", r"using\s+the\s+(?:formula|method)"],
}
TYPE_KEYWORDS = {
    "calculation": ["calculate", "find", "compute", "solve", "value of", "equal to", "what is", "how much", "how many"],
    "conceptual": ["concept", "theory", "principle", "law", "define", "explain", "what is", "why", "difference between"],
    "factual": ["who", "when", "where", "capital", "founder", "inventor", "discovered", "located", "headquarter", "established", "born", "died"],
    "application": ["apply", "using", "given that", "if", "scenario", "situation", "case", "example", "according to"],
}
STARTERS = {
    "calculation": [r"^(?:find|calculate|what is|determine|compute)", r"^(?:how (?:much|many|long|far))"],
    "comparison": [r"^(?:which|who|what) is (?:greater|smaller|more|less|larger)", r"^compare"],
    "selection": [r"^(?:which of the following|choose|select)", r"^(?:identify|pick|point out)"],
    "completion": [r"^(?:complete|fill in|supply)"],
    "true_false": [r"^(?:which (?:statement|option) is (?:true|false|correct|incorrect))"],
}

# --- fixed values: sections by content ---
VERBAL_GUARD = r"synonym|antonym|idiom|one word|one-word|substitution|cloze|fill in the blank|fill in the blanks|error detection|no error|spot the error|improve the sentence|jumbled sentence|para jumble|rearrange the sentence|passage|comprehension"
BLANKS = r"_ _|___|\[\s*\]"
SECTION_WORDS = {
    "numerical_ability": (
        ["calculate", "find the value", "solve", "simplify", "evaluate", "percent", "%", "profit", "loss", "interest", "principal", "speed", "km/hr", "distance", "time taken", "average", "ratio", "proportion", "lcm", "hcf", "divisible", "area", "volume", "perimeter", "circumference", "probability", "permutation", "combination"],
        ["rs.", "rupees", "₹", "cost", "price", "discount", "train", "pipe", "tank", "cistern", "work", "days", "men", "efficiency", "fraction", "decimal"],
    ),
    "verbal_ability": (
        ["synonym", "antonym", "meaning of", "opposite of", "idiom", "phrase means", "one word", "substitution", "error", "grammatical", "no error", "underlined", "rearrange", "jumbled", "passage", "comprehension", "cloze", "fill in the blank", "blank", "appropriate word", "spelling", "spelt", "correctly", "improve the sentence"],
        ["sentence", "word", "grammar", "vocabulary", "speech", "active", "passive", "voice", "direct", "indirect", "paragraph", "author", "read the following"],
    ),
    "reasoning": (
        ["coded", "code", "decode", "cipher", "written as", "analogy", "is to", "as", "same way", "father", "mother", "brother", "sister", "relation", "north", "south", "east", "west", "direction", "facing", "conclusion", "follows", "syllogism", "premises", "venn", "diagram", "circles", "mirror", "water image", "reflection", "embedded", "hidden figure", "pattern", "fold", "unfold", "paper", "punch", "cube", "dice", "faces", "opposite"],
        ["series", "next", "missing", "complete the", "odd one", "different", "does not belong", "clock", "minute", "hour", "hands", "calendar", "day", "week", "leap year", "rank", "position", "seating", "arrangement", "sufficient", "data sufficiency", "statement alone"],
    ),
    "general_awareness": (
        ["capital", "president", "prime minister", "governor", "constitution", "article", "amendment", "parliament", "trophy", "award", "prize", "padma", "bharat ratna", "olympics", "world cup", "tournament", "champion", "river", "mountain", "country", "continent", "dynasty", "emperor", "battle", "independence", "gdp", "budget", "rbi", "economy", "inflation", "launched", "inaugurated", "summit", "agreement", "army", "navy", "air force", "missile", "defence"],
        ["who", "which", "where", "when", "established", "founded", "located", "headquarters", "first", "largest", "longest", "discovered", "invented", "founded", "born", "festival", "dance", "music", "culture", "heritage"],
    ),
}
SECTION_WEIGHTS = {"numerical_ability": (3, 2), "verbal_ability": (4, 2), "reasoning": (4, 2), "general_awareness": (4, 2)}
PASSAGE = r"read the (following )?passage|based on the passage|according to the passage"
FIGURE = r"figure|diagram|image|pattern|shape"
ASKING = r"^(who|what|which|where|when|how many|name the)([^\p{L}\p{N}_]|$)"
YEAR = r"(?:^|[^\p{L}\p{N}_])(19|20)\d{2}(?:[^\p{L}\p{N}_]|$)"

# --- fixed values: formulas, numbers and difficulty ---
FORMULAS = [r"\d+\s*[+\-×÷*/^]\s*\d+", r"[A-Za-z]\s*=\s*[^,]+", r"\d+\s*:\s*\d+", r"\d+%", r"√\d+", r"\d+°"]
MATH_FIXES = [(" x ", " × "), (" X ", " × "), ("**", "^"), ("sqrt", "√"), ("pi", "π")]
OPERATIONS = [
    ("addition", r"[+]"), ("subtraction", r"[-−]"), ("multiplication", r"[×*]"), ("division", r"[÷/]"),
    ("exponentiation", r"(?i)[\^²³]|power|square|cube"), ("percentage", r"(?i)%|percent"), ("root", r"(?i)√|sqrt|root"),
]
UNITS = {
    "speed": r"(\d+\.?\d*)\s*(?:km/?hr?|m/?s|mph|kmph)", "distance": r"(\d+\.?\d*)\s*(?:km|m|meters?|miles?)",
    "time": r"(\d+\.?\d*)\s*(?:hours?|hrs?|minutes?|mins?|seconds?|secs?|days?)", "money": r"(?:Rs\.?|₹|INR)\s*(\d+\.?\d*)", "percentage": r"(\d+\.?\d*)\s*%",
    "ratio": r"(\d+)\s*:\s*(\d+)", "age": r"(\d+)\s*(?:years?|yrs?)\s*(?:old)?", "workers": r"(\d+)\s*(?:men|women|workers?|persons?|people)",
}
COMPLEX_WORDS = [
    "notwithstanding", "henceforth", "whereas", "thereby", "subsequently", "consequently", "nevertheless", "furthermore", "aforementioned", "heretofore", "thereupon",
    "albeit", "ergo", "hence", "thus", "moreover", "paradoxically", "ostensibly", "presumably", "inherently", "intrinsically",
]
STEP_WORDS = ["then", "after", "next", "finally", "first", "second", "step", "followed by", "subsequently", "afterwards", "if...then", "and then"]
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall",
    "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "if", "then", "than", "that", "this", "these", "those", "what", "which", "who", "whom", "how", "when",
    "where", "why", "and", "or", "but", "not", "no", "yes", "all", "each", "every", "find", "calculate", "determine", "given", "following",
]

# --- fixed values: news ---
NEWS_WORDS = {
    "defense": ["indian air force", "iaf", "rafale", "tejas", "sukhoi", "mig", "missile", "brahmos", "agni", "prithvi", "akash", "drdo", "hal", "exercise", "operation", "bilateral", "army", "navy", "coast guard", "paramilitary", "defense budget", "chief of staff", "air marshal"],
    "international": ["summit", "treaty", "agreement", "bilateral", "multilateral", "g20", "brics", "asean", "saarc", "un", "unesco", "prime minister visit", "foreign minister", "mou", "diplomatic", "ambassador", "high commissioner"],
    "sports": ["olympic", "asian games", "commonwealth games", "world cup", "champion", "medal", "trophy", "tournament", "cricket", "hockey", "badminton", "tennis", "chess", "arjuna award", "dronacharya", "khel ratna", "padma"],
    "science": ["isro", "space", "satellite", "launch", "chandrayaan", "mangalyaan", "gaganyaan", "pslv", "gslv", "rocket", "nuclear", "atomic", "research", "discovery", "innovation"],
    "economy": ["budget", "gdp", "rbi", "repo rate", "inflation", "fiscal", "monetary", "niti aayog", "economic survey", "fdi", "export", "import", "trade"],
    "awards": ["bharat ratna", "padma vibhushan", "padma bhushan", "padma shri", "nobel", "booker", "oscar", "grammy", "bafta", "gallantry", "param vir chakra", "ashoka chakra", "shaurya chakra"],
}
NEWS_FULL_WEIGHT = ["defense", "sports", "awards"]
NEWS_NAMES = {"defense": "Defense & Military", "international": "International Relations", "sports": "Sports", "science": "Science & Technology", "economy": "Economy & Budget", "awards": "Awards & Honors"}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]

# --- fixed values: how questions are marked in papers, surest first; the second value tells whether options on the mark's line end the text ---
QUESTION_MARKS = [
    (r"(\d{1,9})\s*[.)]", True), (r"Q\.?\s*(\d{1,9})\s*[.:)]?", False), (r"Question\s+(\d{1,9})\s*[.:)]?", False), (r"\((\d{1,9})\)", True), (r"\[(\d{1,9})\]", True),
    (r"Ques\.?\s*(\d{1,9})\s*[.:)]?", False), (r"(\d{1,9})\s*\.(?=\s*[A-Z])", False), (r"(\d{1,9})\s*:", True),
]
ROMAN_MARK = (r"(x{0,3}(?:ix|iv|v?i{0,3}))\s*[.)]", False)
RELAXED_MARKS = [(r"(8[1-9]|9\d|100)\s+(?=[A-Z])", True), (r"Q\.?\s*(8[1-9]|9\d|100)", True), (r"[\[(](8[1-9]|9\d|100)[\])]", True), (r"(8[1-9]|9\d|100)\s", True)]
LINE_MARK = r"(?i)^(?:\d{1,3}\s*[.):]|Q\.?\s*\d{1,3}|\(\d{1,3}\)|\[\d{1,3}\]|Question\s+\d{1,3}|Ques\.?\s*\d{1,3})"
PAGE_MARK = r"(?i)^---\s*PAGE\s*(\d+)\s*---"

# --- fixed values: figure questions ---
FIGURE_PATTERNS = [
    r"complete\s+the\s+(pattern|series|figure)", r"which\s+(figure|pattern)\s+(completes|comes\s+next)", r"find\s+the\s+missing\s+(figure|pattern|number)",
    r"mirror\s+image", r"water\s+image", r"reflection\s+of",
    r"paper\s+(folding|cutting|punching)", r"fold(ed)?\s+(paper|sheet)",
    r"cube|dice|unfolded", r"opposite\s+(face|side)",
    r"count(ing)?\s+(the\s+)?(triangles?|squares?|figures?|lines?)", r"how\s+many\s+(triangles?|squares?|figures?)",
    r"embedded\s+figure", r"hidden\s+(in|figure)",
    r"figure\s+(series|analogy|matrix)", r"(choose|select|find)\s+the\s+(odd|different)\s+(figure|one)",
    r"rotat(e|ed|ion)", r"position\s+of\s+the",
    r"(see|refer|given|above|below)\s+(figure|diagram|image)", r"in\s+the\s+(given\s+)?(figure|diagram)",
    r"venn\s+diagram", r"shaded\s+(region|area|part)",
]
FIGURE_ASKING = r"\b(is|are|was|were|will|what|which|who|how)\b"
RESCUE_LABELS = {"verbal_ability": "VERBAL", "general_awareness": "GA", "reasoning": "REASONING", "numerical_ability": "MATH"}
