"""Word lists, tables and patterns that results depend on. Patterns are matched on lower-cased text."""

#: Words that a programme key leaves out (F1).
STOPWORDS = ["of", "and", "the", "in", "for", "with", "at", "a", "an", "to"]

#: Names that are navigation: searched anywhere in the name.
NOISE_HEADINGS = (
    r"cookie|privacy|navigation|menu|search|skip to|accept|your .* options|tell us|changes to our|related content|course terms|how to apply|footer|header"
    r"|breadcrumb|sidebar|what'?s new|latest news|news|discovery fair"
)

#: Names that are page furniture: the whole name.
NOISE_NAMES = (
    r"what'?s new|news|(?:\S.*\s+)?overview|introduction|background|home|admissions?|programme(?:s)? list|(?:postgraduate|undergraduate"
    r"|graduate)\s+(?:taught\s+)?(?:programmes?|courses?|degrees?)|degree\s+finder|search\s+(?:programmes?|courses?|degrees?)"
    r"|a\s+to\s+z\s+of\s+(?:degree\s+)?programmes?|browse\s+(?:by\s+)?(?:faculty|subject|department)|all\s+(?:programmes?|courses?)|masters?\s+courses?"
    r"|bachelor'?s?\s+courses?|course\s+search|find\s+a?\s*(?:course|programme|degree)|(?:faculty|school|department|college|institute|centre"
    r"|center)\s+of\s+\S.*|about(?:\s+(?:us|the\s+\S+|our\s+\S+))?|apply(?:\s+(?:now|online|here|today))?|contact(?:\s+(?:us|me))?|visit(?:\s+(?:us|me"
    r"|(?:the\s+)?(?:web\s?site|site|page)))?|enroll(?:ment)?|enrol(?:ment)?|register|get\s+(?:in\s+touch|started)|learn\s+more(?:\s+about\s+\S.*)?"
    r"|find\s+out\s+more|read\s+more|welcome(?:\s+to\s+\S.*)?|tuition\s+fees?\b.*|\S.*\s+(?:web\s?site|site)|\(?\s*deadlines?\s+(?:for|of)\b.*"
    r"|applications?\s+for\s+\S.*|choose\s+your\s+\S.*|follow\s+us\b.*"
)

#: Names that are requirement prose: searched anywhere.
REQUIREMENT_PROSE = (
    r"\b\d\s*:\s*\d\b|^an?\s+(?:good\s+|relevant\s+|strong\s+)?(?:bachelor|master|honours?)\b|\bbachelor\s+degree\s+(?:with|in|plus|or)\b"
    r"|\bhonours\s+degree\b|\bwork\s+experience\b|\bentry\s+requirements?\b|\b(?:ielts|toefl|ukvi)\b|\bto\s+apply\b|\bapplicants?\s+(?:must|should|need|will"
    r"|are|with)\b|\bwe\s+require\b|\byou(?:'ll|\s+will)?\s+(?:need|require|must)\b"
)

#: Degree tokens of URL paths and names.
DEGREES = ["ma", "msc", "mphil", "phd", "mba", "llm", "meng", "march", "mfin", "mres", "dphil", "dba", "edd", "mssc", "msocsc"]

#: Currency signs and codes.
CURRENCIES = {"hk$": "HKD", "hkd": "HKD", "us$": "USD", "usd": "USD", "rmb": "CNY", "cny": "CNY", "£": "GBP", "gbp": "GBP"}

#: Aliases of study modes.
STUDY_MODES = {
    "fulltime": "FullTime", "full_time": "FullTime", "full time": "FullTime", "ft": "FullTime",
    "parttime": "PartTime", "part_time": "PartTime", "part time": "PartTime", "pt": "PartTime", "hybrid": "Hybrid", "mixed": "Hybrid", "blended": "Hybrid",
}

#: Applicant wording to scope, first match wins (F32).
SCOPES = [
    (r"\b(?:local|home|uk)\b.{0,12}\b(?:and|&|/)\b.{0,12}\b(?:non-?local|international|overseas)\b", "all"), (r"\ball\b", "all"), (r"\b(?:uk|home)\s*(?:/|and|&)\s*eu\b", "local"),
    (r"non-?local|international|overseas|\beu\b|非本地|國際|国际", "non_local"), (r"\blocal\b|\bhome\b|\buk\b|domestic|本地", "local"),
    (r"self[-\s]?financ|self[-\s]?fund|ugc[-\s]?fund|government[-\s]?fund|publicly[-\s]?fund|自資|自资|資助|资助", "all"),
]

#: Token, display name, family; first match wins.
EXAMS = [
    ("ielts", "IELTS", "language"), ("toefl", "TOEFL", "language"), ("sat", "SAT", "standardized"), ("act", "ACT", "standardized"), ("gre", "GRE", "standardized"),
    ("gmat", "GMAT", "standardized"), ("a-level", "A-Level", "curriculum"), ("a level", "A-Level", "curriculum"), ("ib", "IB", "curriculum"), ("ap", "AP", "curriculum"),
]

#: URLs that are no programme pages.
NOISE_URL = (
    r"^javascript:|^mailto:|^tel:|^#|^https?://[^/]+/?$|//apply\.|/apply\b|onlineappl|application-form|/cht/|/chs/|/zh[-_/]|/for-prospective-students/|/for-current-students/"
    r"|/admission/list-of-programmes\b|/indicative-timeframe|facebook\.com|instagram\.com|youtube\.com|linkedin\.com|twitter\.com|x\.com|weibo\.com"
    r"|\.(?:pdf|jpe?g|png|gif|svg|mp4|zip)(?:$|\?)"
)

#: Weights of admission sub-links.
SUB_LINKS = [
    ("requirement", 100), (r"tuition|fees?[-/]|[-/]fees?\b", 100), ("admission", 80), ("scholarship", 40), ("deadline", 40),
    ("curriculum|course-detail|course-description", 30), ("programme-information|program-information|overview", 20),
]

#: Anchors that name an action and no programme.
GENERIC_ANCHOR = (
    r"^(?:visit(?:\s+(?:the\s+)?(?:web\s?site|site|page|homepage))?|(?:official|programme|program)\s+(?:web\s?site|site|page)|web\s?site|homepage|home\s?page"
    r"|more(?:\s+(?:info(?:rmation)?|details?))?|details?|click\s+here|here|link)$"
)

#: Link scores (F23): paths of course details and of courses, texts of degrees and of navigation.
COURSE_DETAIL = r"/study/masters/courses/list/\d+/"
COURSE_PATH = r"/(course|courses|programme|programmes?)/"
DEGREE_TEXT = r"\b(msc|ma|mba|llm|mres|mphil|pgdip|pgcert|master|masters|programme|program)\b"
NAV_TEXT = r"\b(home|about|contact|research|news|privacy|cookies|terms|support|menu|search|international|undergraduate|postgraduate)\b"

#: Label of a markdown link, with one level of brackets inside; a link's label and target.
LINK_LABEL = r"(?:[^\[\]]|\[[^\[\]]*\])*"
LINK = rf"\[({LINK_LABEL})\]\(\s*([^)\s]+)"

#: Targets that are assets, and words of URLs of accounts.
ASSETS = [".css", ".js", ".png", ".jpg", ".jpeg", ".ico", ".svg", ".woff", ".ttf"]
ACCOUNTS = ["login", "signin", "admin"]

#: Page types (P14): signals of listings and of details, headings that name a degree, paths of details and of listings.
INDEX_SIGNAL = (
    r"\b(?:find your (?:course|programmes?)|course search|search degree programmes?|showing\s+\d+\s+courses?|filters?|browse(?: by)? subject|a\s*to\s*z"
    r"|degree finder|list of courses?)\b"
)
DETAIL_SIGNAL = (
    r"\b(?:tuition fees?|programme starts?|program starts?|application deadlines?|entry requirements?|admission requirements?|duration|start date|modules?"
    r"|course structure|how to apply|uk tuition fees|international fees|study mode)\b"
)
DEGREE_HEADING = r"(?m)^\s*#\s+.*\b(?:msc|ma|mba|llm|mres|mphil|pgdip|pgcert|master|masters|bsc|ba|meng|beng|phd|doctor)\b"
DETAIL_PATH = r"/(?:courses?/list/\d+|tpg/\d{4}/[0-9a-z\-]{4,}|degrees/[0-9a-z\-]{6,}|programmes?/[0-9a-z\-]{6,}|programs?/[0-9a-z\-]{6,})"
INDEX_PATH = r"find-your-programmes|course-search|/(?:degrees|courses/list|programmes|programs)/*$"

#: Layouts of index pages (F39): degrees at the end and at the start of a label, run-on labels, programme headings, paths.
DEGREE_SUFFIX = r"\b(?:BA|BSc|BASc|BEng|LLB|MArch|MBA|MChem|MComp|MEng|MMath|MPhil|MRes|MSci|MSc|MA|LLM|PhD|DPhil|PGDip|PGCert|FdA|FdSc)\b\s*(?:\([^)]*\))?\s*$"
DEGREE_PREFIX = (
    r"(?i)^(?:MA\b|MSc\b|MBA\b|MPhil\b|MRes\b|MEng\b|LLM\b|PhD\b|DPhil\b|DBA\b|EdD\b|MSSc\b|MSocSc\b|MArch\b|MClinPsych\b|MScM\b|MFin\b"
    r"|Executive\s+(?:MBA|Master)|Juris Doctor|Doctor of |Master of |Postgraduate (?:Certificate|Diploma))"
)
BLOB = (
    r"(?:years?|term|\))\s{2,}([A-Z][A-Za-z0-9 ,&'./-]+?)\s+-\s+(MSc|MA|MBA|MEng|MArch|MFin|MPhil|LLM|MSocSc|MScM|Master|PhD|EdD|DBA)\s+-\s+Master"
)
PROGRAM_PREFIX = r"(?i)^(?:Doctor of |Master of |Bachelor of |Graduate Diploma (?:in|of) |Graduate Certificate (?:in|of) )"
DETAIL_LINK, OTHER_LINK = r"(?i)programme|course", r"(?i)resource|org-asset"
TABLE_PATH, TABLE_CODE = r"/programme/program-list/", r"^[Pp]\d+[a-z]?\s+"
TABLE_DEGREE = (
    r"(?i)^(?:MSc|MA\b|MBA|MEng|MPhil|MRes|LLM|MSocSc|MClinPsych|MSSc|MArch|Master (?:of|in)|Executive Master|Postgraduate (?:Certificate|Diploma)"
    r"|Doctor of|Professional (?:Certificate|Diploma))"
)
DURATION_SUFFIX = r"(?i)\s*\(\s*\d+(?:\s*(?:or|to|and|-|–|/)\s*\d+)?\s*years?\s*\)\s*$"

#: Page parameters by priority.
PAGE_PARAMS = ["page", "p", "pg", "offset", "start_rank"]
#: Words of URLs of detail pages.
DETAIL_WORDS = r"/programme|/program|/course|/master|/msc|/ma-|/degree|/undergraduate|/postgraduate"

#: Tests that a requirement's threshold may belong to.
TESTS = r"\b(toefl|ielts|cet-?6|cet-?4|gre|gmat|sat|act|hkdse|gaokao|duolingo|pte|celpip|toeic)\b"
#: Requirement lines and their categories, first match wins.
REQUIREMENT_WORDS = ["ielts", "toefl", "duolingo", "gre", "gmat", "entry requirement", "entry requirements", "english language", "a-level", "a level", "ib diploma"]
REQUIREMENT_KINDS = [
    ("language", r"\bielts\b|\btoefl\b|\bduolingo\b|english language"), ("standardized_test", r"\bsat\b|\bact\b|\bgre\b|\bgmat\b"),
    ("academic_subject", r"a-level|a level|\bib diploma\b|entry requirement"),
]
OPTION_WORDS = ["full-time", "full time", "part-time", "part time", "duration", "months", "month", "year"]
DEADLINE_WORDS = ["deadline", "application closes", "applications close", "closing date", "apply by"]

#: Allowed values of typed fields.
CURRENCY_CODES = ["HKD", "USD", "CNY", "GBP", "EUR", "AUD", "CAD", "SGD", "JPY", "OTHER"]
MODES = ["FullTime", "PartTime", "Hybrid", "Unknown"]
BASES = ["per_programme", "per_annum", "per_semester", "per_credit"]
APPLICANTS = ["all", "local", "non_local"]
CATEGORIES = ["academic_subject", "language", "standardized_test", "portfolio", "experience", "other"]
STAGES = ["fetch_raw", "extract_structured", "validate_rules", "persist_versioned"]
